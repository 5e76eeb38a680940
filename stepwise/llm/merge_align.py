"""Alignment of two tokenizers' tokens by a merge of their end positions.

Tokens of A and B cover the same bytes, so their end offsets are two sorted
lists.  Merge-path partitioning cuts the merge of both lists into pieces of
equal work: a binary search along each diagonal finds how many ends of either
list come before it.  All pieces then advance together, one numpy step for all;
every step emits the overlap of the current A and the current B token.  A
place where both lists end closes a group, wherever it lies in a piece; the
number of closed groups of the pieces before stitches groups that run over a
border.

A blank between two characters that are no white space starts a token in both
tokenizers, so the text between two such blanks (a unit) is tokenized and merged
once per task and reused.  What a pair of ids counts for in the whole corpus is
joined afterwards: the most frequent pairs, a fixed number, are broadcast, all
others are joined by a shuffle, so no frequent pair gathers in one task.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm import textops as tx
from stepwise.llm.storage import saved

PIECE_WORK = 64                 # ends in a piece of the merge
# Characters of text that are aligned at once; longer texts advance in such parts.
PART_CHARS = 1 << 19
# Characters of units a task remembers; beyond that the units used once are forgotten.
MEMO_CHARS = 3 << 20
# Pairs of ids whose counts are broadcast (17 bytes each); the others are joined.
BROADCAST_PAIRS = 1 << 18
# Groups with more links than this list different ids only.
WIDE_GROUP = 4096
# Longest unit that the fast encoder of byte-level ranks gets, and length of a run of joined units.
FAST_CHARS = 2048
RUN_CHARS = 4096
# Fixed value: how byte-level tokenizers of this kind split a text (as their library does).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SPACE = "▁"                # written for a blank by tokenizer B
_CUT = re.compile(r" (?<=\S )(?=\S)")


# -- merge path --------------------------------------------------------------

def diagonal_splits(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` merged values come from ``a``, for every diagonal d (ties: a first)."""
    low = np.maximum(0, diagonals - len(b))
    high = np.minimum(diagonals, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        right = a[mid] <= b[diagonals[open_] - 1 - mid]
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]


def merge_groups(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of every A token, group of every B token, and overlaps (A token, B token).

    ``a`` and ``b`` are strictly increasing end offsets with the same last
    value.  A group ends where both lists have an end.
    """
    total = len(a) + len(b)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    diagonals = np.arange(0, total, work, dtype=np.int64)
    i = diagonal_splits(a, b, diagonals)
    j = diagonals - i
    # one more value above all others ends both lists
    a_end, b_end = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    pieces = len(diagonals)
    at_a, at_b = np.empty((work, pieces), np.int64), np.empty((work, pieces), np.int64)
    from_a = np.empty((work, pieces), bool)
    for s in range(work):
        at_a[s], at_b[s] = i, j
        take = a_end[i] <= b_end[j]
        from_a[s] = take
        i = np.minimum(i + take, len(a))
        j = np.minimum(j + ~take, len(b))
    # the second of two equal ends closes a group and is no overlap of its own
    closes = ~from_a & (at_a > 0) & (b_end[at_b] == a_end[at_a - 1])
    closes.reshape(-1, order="F")[total:] = False
    closed = closes.sum(0)
    before = np.cumsum(closed) - closed                     # stitches the pieces
    group = (before[None] + np.cumsum(closes, 0) - closes).reshape(-1, order="F")[:total]
    flat = lambda x: x.reshape(-1, order="F")[:total]
    from_a, closes = flat(from_a), flat(closes)
    overlaps = np.stack((flat(at_a), flat(at_b)), 1)[~closes]
    return group[from_a], group[~from_a], overlaps


# -- the two tokenizers --------------------------------------------------------

def _byte_alphabet() -> dict[str, int]:
    """Byte of every character of the byte-level alphabet.

    Printable bytes stand for themselves, the others are numbered from U+0100.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class _Table:
    """Bytes of all ids of a tokenizer as one array with offsets."""

    def __init__(self, parts: list[bytes]):
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(x) for x in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[tx.spread(self.start[ids], self.size[ids])]


class ByteLevel:
    """Tokenizer A: byte-level pieces of a ``.json`` file; a unit is read with a blank before it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._path = path
        byte = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        parts = [b""] * (1 + max(vocab.values()))
        for text, i in vocab.items():
            if all(c in byte for c in text):
                parts[i] = bytes([byte[c] for c in text])
        self.table = _Table(parts)
        self._fast = self._by_ranks(spec, vocab, parts)

    @staticmethod
    def _by_ranks(spec: dict, vocab: dict[str, int], parts: list[bytes]):
        """A faster encoder of the same vocabulary, if its merges are numbered in their order."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [vocab.get(m.replace(" ", "")) for m in merges]
        if (pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space")
                or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges")
                or made != list(range(256, 256 + len(made))) or not all(map(len, parts[:256 + len(made)]))):
            return None
        import tiktoken
        ranks = {parts[i]: i for i in range(256 + len(made))}
        return tiktoken.Encoding("from-file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._fast is not None and all(len(x) <= 2 * RUN_CHARS for x in texts):
            return [self._fast.encode_ordinary(" " + x) for x in texts]
        return [e.ids for e in self._tok.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]

    @functools.cached_property
    def _tok(self):
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(self._path)
        tok.encode_special_tokens = True        # their strings in a text are ordinary text
        tok.no_truncation()
        tok.no_padding()
        return tok


class Pieces:
    """Tokenizer B: a SentencePiece ``.model`` that puts a blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        parts = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                parts.append(bytes([int(piece[3:5], 16)]))
            else:
                if SPACE in piece.lstrip(SPACE) and not sp.is_control(i) and not sp.is_unknown(i):
                    raise ValueError("a piece spans two words")
                parts.append(piece.replace(SPACE, " ").encode())
        self._sp, self.table = sp, _Table(parts)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._sp.encode(texts, num_threads=1)


# -- units and documents -------------------------------------------------------

class Aligner:
    """Aligned units of two tokenizers, remembered within a task."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.width = len(self.b.table.size)     # a pair is a * width + b
        most = max(len(self.a.table.size), self.width)
        self.decimal = _Table([b"%d," % i for i in range(most)])
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.chars = 0
        self.text: list[bytes] = []             # groups of a unit as text
        self.used = np.zeros(0, np.int64)       # how often a unit came
        # per unit: tokens of A, of B, groups, links, and whether both give the unit's bytes back
        self.size = np.zeros((0, 5), np.int64)
        self.ends = np.zeros(1, np.int64)       # offsets of a unit's pairs
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        """Forget the units that came once, or all if that frees less than half."""
        keep = np.flatnonzero(self.used > 1)
        units = list(self.row)                  # in the order of their rows
        kept = [units[k] for k in keep.tolist()]
        chars = sum(map(len, kept))
        if chars > MEMO_CHARS // 2:
            self.clear()
            return
        count = np.diff(self.ends)[keep]
        at = tx.spread(self.ends[keep], count)
        self.row, self.chars = dict(zip(kept, range(len(kept)))), chars
        self.text, self.used, self.size = [self.text[k] for k in keep.tolist()], self.used[keep], self.size[keep]
        self.pair, self.times = self.pair[at], self.times[at]
        self.ends = np.concatenate(([0], np.cumsum(count)))

    def learn(self, plain: list[str], odd: list[str]) -> None:
        """Tokenize and merge units that are not in the memo yet; plain ones can be joined by blanks."""
        units = plain + odd
        flat_a, na = self._encode(self.a, plain, odd)
        flat_b, nb = self._encode(self.b, plain, odd)
        sound = self._sound(units, flat_a, na, flat_b, nb)
        lane_a, lane_b = np.repeat(sound, na), np.repeat(sound, nb)
        flat_a, flat_b = flat_a[lane_a], flat_b[lane_b]
        na, nb = np.where(sound, na, 0), np.where(sound, nb, 0)
        group_a, group_b, _ = merge_groups(np.cumsum(self.a.table.size[flat_a]),
                                           np.cumsum(self.b.table.size[flat_b]))
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
        # a unit ends a group, so groups belong to units
        first = np.concatenate(([0], np.searchsorted(to_a, np.cumsum(na), "right")))
        links = np.concatenate(([0], np.cumsum(in_a * in_b)))[first]
        size = np.stack((na, nb, np.diff(first), np.diff(links), sound), 1)
        owner, pair, times = self._pairs(flat_a, flat_b, in_a, in_b, to_a, to_b, first)
        self.text += self._group_texts(flat_a, flat_b, group_a, group_b, to_a, to_b, first)
        at = len(self.row)
        self.row.update(zip(units, range(at, at + len(units))))
        self.chars += sum(map(len, units))
        self.size = np.concatenate((self.size, size))
        self.used = np.concatenate((self.used, np.zeros(len(units), np.int64)))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(
            np.bincount(owner, minlength=len(units)))))
        self.pair, self.times = np.concatenate((self.pair, pair)), np.concatenate((self.times, times))

    @staticmethod
    def _encode(side, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and their number for every unit.

        Plain units start and end without white space, so a run of them joined
        by blanks is encoded at once and cut where the units' bytes end.
        """
        size = np.array([len(u) for u in plain], np.int64)
        lead = np.cumsum(size + 1)
        runs = np.concatenate(([0], np.flatnonzero(np.diff(lead // RUN_CHARS)) + 1, [len(plain)])).tolist()
        ids = side.encode([" ".join(plain[s:e]) for s, e in zip(runs, runs[1:]) if e > s])
        flat = np.array(list(itertools.chain.from_iterable(ids)), np.int64)
        ends = np.cumsum(side.table.size[flat])
        to = np.searchsorted(ends, np.cumsum(_utf8_sizes(plain, size) + 1), "right")
        alone = side.encode(odd) if odd else []
        return (np.concatenate((flat, np.array(list(itertools.chain.from_iterable(alone)), np.int64))),
                np.concatenate((np.diff(to, prepend=0), np.array([len(x) for x in alone], np.int64))))

    def _sound(self, units, flat_a, na, flat_b, nb) -> np.ndarray:
        """Units whose bytes both tokenizers give back."""
        raw = [(" " + u).encode("utf-8", "surrogatepass") for u in units]
        ok = np.ones(len(units), bool)
        for flat, n, table in ((flat_a, na, self.a.table), (flat_b, nb, self.b.table)):
            back, to = table.bytes_of(flat).tobytes(), np.concatenate(([0], np.cumsum(n)))
            if back != b"".join(raw):
                ends = np.concatenate(([0], np.cumsum(table.size[flat])))[to].tolist()
                ok &= np.array([back[s:e] == r for s, e, r in zip(ends, ends[1:], raw)], bool)
        return ok

    def _group_texts(self, flat_a, flat_b, group_a, group_b, to_a, to_b, first) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` for the groups of every unit."""
        before_a, before_b = np.concatenate(([0], to_a)), np.concatenate(([0], to_b))
        ids = np.empty(len(flat_a) + len(flat_b), np.int64)
        ids[np.arange(len(flat_a)) + before_b[group_a]] = flat_a
        ids[np.arange(len(flat_b)) + before_a[group_b + 1]] = flat_b
        out = self.decimal.bytes_of(ids)
        ends = np.concatenate(([0], np.cumsum(self.decimal.size[ids])))
        out[ends[to_a + before_b[:-1]] - 1] = ord("|")
        out[ends[to_a + to_b] - 1] = ord(";")
        unit, text = ends[(before_a + before_b)[first]].tolist(), out.tobytes()
        return [text[s:max(s, e - 1)] for s, e in zip(unit, unit[1:])]

    def _pairs(self, flat_a, flat_b, in_a, in_b, to_a, to_b, first):
        """Unit, pair and number of links of all groups, units in order."""
        links = in_a * in_b
        unit = np.repeat(np.arange(len(first) - 1), np.diff(first))
        plain = np.flatnonzero(links <= WIDE_GROUP)
        n = links[plain]
        group = np.repeat(plain, n)
        k = tx.spread(np.zeros(len(n), np.int64), n)
        a = flat_a[to_a[group] - in_a[group] + k // in_b[group]]
        b = flat_b[to_b[group] - in_b[group] + k % in_b[group]]
        owner, pair, times = [unit[group]], [a * self.width + b], [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(links > WIDE_GROUP):
            a, ka = np.unique(flat_a[to_a[g] - in_a[g]:to_a[g]], return_counts=True)
            b, kb = np.unique(flat_b[to_b[g] - in_b[g]:to_b[g]], return_counts=True)
            pair.append((a[:, None] * self.width + b).reshape(-1))
            times.append((ka[:, None] * kb).reshape(-1))
            owner.append(np.full(len(pair[-1]), unit[g]))
        owner, pair, times = map(np.concatenate, (owner, pair, times))
        if len(plain) < len(links):
            order = np.argsort(owner, kind="stable")
            owner, pair, times = owner[order], pair[order], times[order]
        return owner, pair, times

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """Yields (text number, sizes, groups as text, pairs, links of each) per part of a text, in order."""
        waiting, chars = [], 0
        for t, text in enumerate(texts):
            for part in _parts(text):
                waiting.append((t, part))
                chars += len(part)
                if chars >= PART_CHARS:
                    yield from self._align_parts(waiting)
                    waiting, chars = [], 0
        yield from self._align_parts(waiting)

    def _align_parts(self, parts: list[tuple[int, str]]) -> Iterator[tuple]:
        if self.chars > MEMO_CHARS:
            self.trim()
        split = [_CUT.split(part) for _, part in parts]
        rows = [list(map(self.row.get, units)) for units in split]
        missing = [[k for k, r in enumerate(row) if r is None] for row in rows]
        new = {units[k] for units, ks in zip(split, missing) for k in ks}
        if new:
            # white space at an end of a unit is found at the ends of a part only
            edge = {u for units in split for u in (units[0], units[-1])
                    if not u or u[0].isspace() or u[-1].isspace()}
            odd = {u for u in new if len(u) > FAST_CHARS or SPACE in u or u in edge}
            self.learn(list(new - odd), list(odd))
            for row, units, ks in zip(rows, split, missing):
                for k in ks:
                    row[k] = self.row[units[k]]
        for (t, _), row in zip(parts, rows):
            unit, seen = np.unique(np.array(row, np.int64), return_counts=True)
            self.used[unit] += seen
            count = self.ends[unit + 1] - self.ends[unit]
            at = tx.spread(self.ends[unit], count)
            pair, times = _folded(self.pair[at], self.times[at] * np.repeat(seen, count))
            size = (self.size[unit] * seen[:, None]).sum(0)
            whole = size[4] == len(row)
            yield t, size[:4], whole, b";".join(map(self.text.__getitem__, row)), pair, times


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``PART_CHARS`` characters, cut between units; none for an empty text."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = _CUT.search(text, at + PART_CHARS)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.end()
    if text:
        yield text[at:] if at else text


def _utf8_sizes(texts: list[str], size: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of every text of the given number of characters."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return np.diff(np.concatenate(([0], np.cumsum(wide)))[np.concatenate(([0], np.cumsum(size)))])


def _folded(pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in order and the sum of their links."""
    if not len(pair):
        return pair, times
    order = np.argsort(pair)
    pair, times = pair[order], times[order]
    new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    return pair[new], np.add.reduceat(times, new)


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _align_rows(aligner: Aligner, texts: list[str], as_text: bool):
    """Columns of the aligned texts: sizes, groups (or their digest), pair lists."""
    size = np.zeros((len(texts), 4), np.int64)
    sound, found = np.ones(len(texts), bool), [[] for _ in texts]
    groups = [None] * len(texts)
    for t, n, whole, text, pair, times in aligner.align(texts):
        size[t] += n
        sound[t] &= whole
        found[t].append((pair, times))
        if as_text:
            groups[t] = text if groups[t] is None else b";".join((groups[t], text))
        elif groups[t] is None:
            groups[t] = hashlib.sha256(text)
        else:
            groups[t].update(b";" + text)
    size[~sound] = 0
    pairs, times = [], []
    for t, parts in enumerate(found):
        if not parts or not sound[t]:
            groups[t], p, k = "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            groups[t] = groups[t].decode() if as_text else groups[t].hexdigest()
            p, k = parts[0] if len(parts) == 1 else _folded(*map(np.concatenate, zip(*parts)))
        pairs.append(p)
        times.append(k)
    off = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pairs]))), pa.int32())
    lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x or [np.zeros(0, np.int64)]), pa.int64()))
             for x in (pairs, times)]
    return [*(pa.array(size[:, k]) for k in range(4)), pa.array(groups, pa.string()), *lists]


_SIZES = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, model_a: str, model_b: str, *, id_col: str = "doc_id",
            text_col: str = "text", groups: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    ``groups`` is the text ``a1,a2|b1;a3|b2`` or, with ``groups="sha256"``, its
    digest; ``pairs`` lists the linked id pairs (A id times B's vocabulary size
    plus B id), ``times`` their links.  A text that is null, empty or not given
    back by both tokenizers has no tokens: zeros, an empty ``groups``, no pairs.
    Long texts advance in parts; repeated rows stay; other columns are ignored;
    an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *_SIZES, "groups", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(model_a, model_b)
        try:
            for batch in batches:
                for part in tx.slices(batch, "text", 2 << 20):
                    texts = [x or "" for x in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), *_align_rows(aligner, texts, groups == "text")], names)
        finally:
            aligner.clear()         # the worker lives on with other stages

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, {', '.join(f'{n} long' for n in _SIZES)}, groups string, "
                             "pairs array<long>, times array<long>"))


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether no pair of its A id has more."""
    counts = saved(rows.select(F.explode("pairs").alias("pair")).groupBy("pair")
                   .agg(F.count("*").alias("n")).withColumn("a", F.expr(f"pair div {width}")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return saved(counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")),
                 "pair-best")


def align_documents(docs: DataFrame, model_a: str, model_b: str, *, id_col: str = "doc_id",
                    text_col: str = "text", groups: str = "text",
                    broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``n_best`` counts the links whose pair of ids is held by as many documents
    as any pair of that A id (ties included), ``count_sum`` adds up the number
    of documents over all links.  Every row counts as a document.  Otherwise as
    ``aligned``, also for null, empty and very long texts and empty tables.
    """
    spark = docs.sparkSession
    width = len(_aligner(model_a, model_b).b.table.size)
    rows = saved(aligned(docs, model_a, model_b, id_col=id_col, text_col=text_col, groups=groups)
                 .withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows, width)
    often = counts.orderBy(F.desc("n"), "pair").limit(broadcast_pairs).toArrow().sort_by("pair")
    hot = spark.sparkContext.broadcast(tuple(
        often.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
    names = ["row", "id", *_SIZES, "groups", "n_best", "count_sum", "pairs", "times"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = hot.value
        for batch in batches:
            lists = batch.column("pairs")
            off = np.asarray(lists.offsets, np.int64)
            off, mine = off - off[0], lists.flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, mine), max(0, len(pair) - 1))
            hit = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
            worth = np.zeros((2, len(mine)), np.int64)
            worth[0, hit] = times[hit] * best[at[hit]]
            worth[1, hit] = times[hit] * n[at[hit]]
            total = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(worth, 1)), 1)[:, off]
            rest = pa.array(np.concatenate(([0], np.cumsum(~hit)))[off], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:-4]), pa.array(np.diff(total[0])), pa.array(np.diff(total[1])),
                 pa.ListArray.from_arrays(rest, pa.array(mine[~hit])),
                 pa.ListArray.from_arrays(rest, pa.array(times[~hit]))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    known = saved(rows.select(*names[:-4], "pairs", "times").mapInArrow(
        look_up, f"row long, id {kind}, {', '.join(f'{n} long' for n in _SIZES)}, groups string, "
                 "n_best long, count_sum long, pairs array<long>, times array<long>"), "pair-sums")
    rare = (known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
            .select("row", "x.pairs", "x.times")
            .join(counts.withColumnRenamed("pair", "pairs"), "pairs")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                F.sum(F.col("times") * F.col("n")).alias("more")))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (known.drop("pairs", "times").join(rare, "row", "left")
            .select(F.col("id").alias(id_col), *_SIZES, (F.col("n_best") + more("more_best")).alias("n_best"),
                    (F.col("count_sum") + more("more")).alias("count_sum"), "groups"))
