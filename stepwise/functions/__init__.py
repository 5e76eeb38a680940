"""Column expressions shared by the operators (all JVM-side, codegen-able)."""

from stepwise.functions.columns import (  # noqa: F401
    changed, dampen, distance, duplicate_value, format_2dp, gaussian,
    gradient_step, over_threshold, smaller, uniform,
)
