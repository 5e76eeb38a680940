"""Sources and sinks: edge text, blank-separated numbers, iteration state,
inputs derived from the test tables, and deterministic generators."""
