"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

Words of equal length advance together.  At every end position the hashes of
the substrings that end there are looked up among the sorted piece hashes,
and a vectorised maximum over the start positions keeps score and
backpointer.

* A unigram model maximises the sum of piece scores.
* A byte-pair model (the public vocabulary file is one) takes merges in rank
  order, so its segmentation is not the best sum of scores.  It is, though,
  the only path of pieces in which every two neighbours are stable, meaning
  that no merge across their border would have come before the merges that
  formed them.  The same pass therefore maximises over stable steps only and
  gives the library's ids exactly.

Characters without a piece fall back to their bytes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm import textops as tx
from stepwise.llm.textops import U64

SPACE = "▁"                # written for a blank
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6     # piece types of the file format
UNIGRAM, BPE = 1, 2                                                 # model types of the file format
NO_MERGE = np.inf
MEMO_WORDS = 300_000            # words remembered; beyond that those used once are forgotten
KEPT_WORDS = 60_000             # words used most that the worker keeps from task to task
PAIR_BITS = 20                  # slots that remember whether two pieces are stable
SLICE_BYTES = 4 << 20           # text that advances together; less takes less memory and more time
_INDEX_BITS = 20
_WORD = re.compile(f"{SPACE}*[^{SPACE}]*")


class Codec:
    """Pieces of one model file, indexed by hash."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        m.ParseFromString(model)
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are read")
        self.bpe = m.trainer_spec.model_type == BPE
        if not self.bpe and m.trainer_spec.model_type != UNIGRAM:
            raise ValueError("neither a unigram nor a byte-pair model")
        if any(p.type in (USER, UNUSED) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.texts = [p.piece for p in m.pieces]
        self.types = np.array([p.type for p in m.pieces], np.int8)
        self.unknown = int(np.flatnonzero(self.types == UNKNOWN)[0])
        self.byte_ids = np.full(256, self.unknown)
        for i in np.flatnonzero(self.types == BYTE):
            self.byte_ids[int(self.texts[i][3:5], 16)] = i
        self.falls_back = bool((self.types == BYTE).any())
        if any(self.types[i] == NORMAL and SPACE in t.lstrip(SPACE) for i, t in enumerate(self.texts)):
            raise ValueError("a piece spans two words")
        ids = np.flatnonzero(self.types == NORMAL)
        codes = [np.frombuffer(self.texts[i].encode("utf-32-le"), np.uint32) for i in ids]
        self.longest = max(map(len, codes))
        table = np.zeros((len(ids), self.longest), np.uint32)
        for row, c in enumerate(codes):
            table[row, :len(c)] = c
        lengths = np.array([len(c) for c in codes])
        value = np.zeros(len(ids), U64)             # hash without length, see _extend
        for j in range(self.longest):
            value = np.where(j < lengths, _extend(value, table[:, j]), value)
        order = np.argsort(value)
        self.key, self.ids, self.table = value[order], ids[order], table[order]
        if len(np.unique(self.key)) != len(self.key):
            raise ValueError("two pieces share a hash")
        self.lengths = lengths[order]
        self.score = np.array([m.pieces[i].score for i in self.ids], np.float64)
        top = (self.key >> U64(64 - _INDEX_BITS)).astype(np.int64)
        in_slot = np.bincount(top, minlength=1 << _INDEX_BITS)
        self.head = np.cumsum(in_slot) - in_slot
        self.filled, self.crowd = in_slot > 0, int(in_slot.max())
        self.power = tx.powers(self.longest + 1)[0].copy()
        self.worst = float(self.score.min()) - 10.0     # score of an unknown character
        self.memo = _Memo()
        self.pair_of, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        if self.bpe:
            self._derive()

    # -- pieces by hash ---------------------------------------------------

    def find(self, value: np.ndarray) -> np.ndarray:
        """Row of the piece with this hash, or -1; the top bits lead into the sorted keys."""
        out = np.full(len(value), -1, np.int64)
        top = (value >> U64(64 - _INDEX_BITS)).astype(np.int64)
        maybe = np.flatnonzero(self.filled[top])
        at, value = self.head[top[maybe]], value[maybe]
        for _ in range(self.crowd):
            hit = self.key[at] == value
            out[maybe[hit]] = at[hit]
            at = np.minimum(at + 1, len(self.key) - 1)
        return out

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of the piece that two pieces make together, or -1."""
        out = np.full(len(a), -1, np.int64)
        fits = np.flatnonzero((a >= 0) & (b >= 0))
        fits = fits[self.lengths[a[fits]] + self.lengths[b[fits]] <= self.longest]
        value = self.key[a[fits]] * self.power[self.lengths[b[fits]]] + self.key[b[fits]]
        out[fits] = self.find(value)
        return out

    def _derive(self) -> None:
        """The last merge of every piece and the time of the merge.

        A piece's time is its rank (higher score first).  A merge may not
        come before the merges that made its parts, which holds for trained
        vocabularies and is checked here; a piece that its own text does not
        encode to can never appear and is struck out.
        """
        n = len(self.key)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.time = np.where(self.lengths == 1, -np.inf, -self.score)
        self.alive = self.lengths == 1
        rows_of = {self.texts[i]: r for r, i in enumerate(self.ids)}
        for r in range(n):
            if self.lengths[r] == 1:
                continue
            got = _merge_all(self.texts[self.ids[r]], rows_of, self.time)
            if got is None:
                continue
            self.left[r], self.right[r] = got
            self.alive[r] = True
            if max(self.time[got[0]], self.time[got[1]]) > self.time[r]:
                raise ValueError("a merge comes before its parts; not a trained vocabulary")

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b (rows) stay two pieces side by side; answers are remembered by pair."""
        ok = np.ones(len(a), bool)
        both = np.flatnonzero((a >= 0) & (b >= 0))     # unknown characters never merge
        pair = a[both] * len(self.key) + b[both]
        slot = (tx.mix64(pair) >> U64(64 - PAIR_BITS)).astype(np.int64)
        known = self.pair_of[slot] == pair
        new, back = np.unique(pair[~known], return_inverse=True)
        answer = self.pair_ok[slot]
        if len(new):
            now = self._stable_now(new // len(self.key), new % len(self.key))
            answer[~known] = now[back]
            at = (tx.mix64(new) >> U64(64 - PAIR_BITS)).astype(np.int64)
            # of two pairs for a slot the later write must set both arrays
            last = np.unique(at[::-1], return_index=True)[1]
            at, new, now = at[::-1][last], new[::-1][last], now[::-1][last]
            self.pair_of[at], self.pair_ok[at] = new, now
        ok[both] = answer
        return ok

    def _stable_now(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stable`` for known pieces, worked out.

        Undoes both pieces' merges at the border, latest first.  Two parts
        that stand side by side between their forming and their next merge
        join if their joint piece ranks before those next merges; of equal
        ranks the one further left comes first.
        """
        ok = np.ones(len(a), bool)
        lane = np.arange(len(a))
        x, y = a, b
        x_end, y_end = np.full(len(lane), NO_MERGE), np.full(len(lane), NO_MERGE)
        while len(lane):
            joint = self._joined(x, y)
            r = np.where(joint >= 0, self.time[joint], NO_MERGE)
            together = (self.time[y] < x_end) & (self.time[x] <= y_end)
            broken = (joint >= 0) & together & (r < x_end) & (r <= y_end)
            ok[lane[broken]] = False
            undo_x = self.time[x] > self.time[y]        # of equal times the right one is later
            over = broken | ((self.lengths[x] == 1) & (self.lengths[y] == 1))
            undo_x |= self.lengths[y] == 1
            undo_x &= self.lengths[x] > 1
            x_end = np.where(undo_x, self.time[x], x_end)
            y_end = np.where(undo_x, y_end, self.time[y])
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            keep = ~over
            lane, x, y, x_end, y_end = lane[keep], x[keep], y[keep], x_end[keep], y_end[keep]
        return ok

    # -- encoding ----------------------------------------------------------

    def _same_length(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, and their number; ``code`` is words x length."""
        n, length = code.shape
        pre = np.zeros((length + 1, n), U64)
        for j in range(length):
            pre[j + 1] = _extend(pre[j], code[:, j])
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        last = np.full((length + 1, n), -1, np.int64)   # row of the piece that ends here
        step = np.zeros((length + 1, n), np.int64)      # its length: the backpointer
        for end in range(1, length + 1):
            for size in range(min(end, self.longest), 0, -1):     # of equal sums the longest last piece
                start = end - size
                row = self.find(pre[end] - pre[start] * self.power[size])
                lane = np.flatnonzero((row >= 0) & (best[start] > -np.inf))
                lane = lane[(self.table[row[lane], :size] == code[lane, start:end]).all(1)
                            & (self.lengths[row[lane]] == size)]
                if not len(lane):
                    continue
                r = row[lane]
                if self.bpe:
                    fits = self.alive[r]
                    if start:
                        fits &= self.stable(last[start, lane], r)
                    lane, r = lane[fits], r[fits]
                    value = best[start, lane] + 1.0 / length
                else:
                    value = best[start, lane] + self.score[r]
                better = value > best[end, lane]
                lane, r = lane[better], r[better]
                best[end, lane], last[end, lane], step[end, lane] = value[better], r, size
            # a character without a piece stands alone
            alone = np.flatnonzero((best[end - 1] > -np.inf)
                                   & (self.find(pre[end] - pre[end - 1] * self.power[1]) < 0))
            value = best[end - 1, alone] + (0.0 if self.bpe else self.worst)
            better = value > best[end, alone]
            alone = alone[better]
            best[end, alone], last[end, alone], step[end, alone] = value[better], -1, 1
        made = np.full((n, length), -1, np.int64)       # token at the place where it starts
        at, lanes = np.full(n, length), np.arange(n)
        while len(lanes):
            rows, size = last[at[lanes], lanes], step[at[lanes], lanes]
            at[lanes] -= size
            made[lanes, at[lanes]] = np.where(rows >= 0, self.ids[rows], -2 - code[lanes, at[lanes]].astype(np.int64))
            lanes = lanes[at[lanes] > 0]
        used = made != -1
        return self._unknown_as_bytes(made[used], used.sum(1))

    def _unknown_as_bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces characters without a piece (-2 - code) by their bytes or the unknown piece."""
        odd = flat < 0
        if not odd.any():
            return flat, counts
        lane = np.repeat(np.arange(len(counts)), counts)
        if self.falls_back:
            text = {c: chr(-2 - c).encode("utf-8", "surrogatepass") for c in np.unique(flat[odd]).tolist()}
            wide = np.ones(len(flat), np.int64)
            wide[odd] = [len(text[c]) for c in flat[odd].tolist()]
            new = np.repeat(np.where(odd, 0, flat), wide)
            new[np.repeat(odd, wide)] = self.byte_ids[
                np.frombuffer(b"".join([text[c] for c in flat[odd].tolist()]), np.uint8)]
            return new, np.bincount(lane, wide, len(counts)).astype(np.int64)
        # neighbouring unknown characters are one unknown piece
        again = np.zeros(len(flat), bool)
        again[1:] = odd[1:] & odd[:-1] & (lane[1:] == lane[:-1])
        return np.where(odd, self.unknown, flat)[~again], np.bincount(lane[~again], minlength=len(counts))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and their number for every word.

        Words are sorted into batches of equal length.
        """
        size = np.array([len(w) for w in words], np.int64)
        flats, counts, places = [], [], []
        for length in np.unique(size[size > 0]):
            group = np.flatnonzero(size == length)
            room = max(1, (1 << 18) // int(length))
            for i in range(0, len(group), room):
                part = group[i:i + room]
                text = "".join([words[k] for k in part.tolist()]).encode("utf-32-le", "surrogatepass")
                ids, n = self._same_length(np.frombuffer(text, np.uint32).reshape(len(part), length))
                flats.append(ids)
                counts.append(n)
                places.append(part)
        total = np.zeros(len(words), np.int64)
        if not places:
            return np.zeros(0, np.int64), total
        flat, n, place = np.concatenate(flats), np.concatenate(counts), np.concatenate(places)
        total[place] = n
        starts = np.zeros(len(words), np.int64)
        starts[place] = np.cumsum(n) - n
        return flat[tx.spread(starts, total)], total

    def words(self, text: str) -> list[str]:
        """The parts of a text that no piece can span: a run of blanks and what follows."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return _WORD.findall(SPACE + text if self.prefix else text)[:-1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and offsets per text.

        Each different word is segmented once and remembered.
        """
        memo = self.memo
        if len(memo.row) > MEMO_WORDS:
            memo.trim(MEMO_WORDS // 2)
        rows, ends = [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            words = self.words(text or "")
            new = {w for w in words if w not in memo.row}
            if new:
                memo.wait(new)
            rows += map(memo.row.__getitem__, words)
            ends[i + 1] = len(rows)
        memo.settle(self.encode_words)
        rows = np.array(rows, np.int64)
        memo.used += np.bincount(rows, minlength=len(memo.used))
        count = memo.offsets[rows + 1] - memo.offsets[rows]
        total = np.concatenate(([0], np.cumsum(count)))
        return memo.ids[tx.spread(memo.offsets[rows], count)], total[ends]

    # -- decoding ----------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the ids; control pieces are silent, bytes that are no UTF-8 become U+FFFD."""
        if not hasattr(self, "_bytes"):
            parts = []
            for text, kind in zip(self.texts, self.types):
                parts.append(bytes([int(text[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN
                             else b"" if kind == CONTROL else text.replace(SPACE, " ").encode())
            self._bytes = np.frombuffer(b"".join(parts), np.uint8)
            self._ends = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        ids = np.asarray(ids, np.int64)
        count = self._ends[ids + 1] - self._ends[ids]
        out = self._bytes[tx.spread(self._ends[ids], count)].tobytes()
        at = np.concatenate(([0], np.cumsum(count)))[offsets].tolist()
        texts = [out[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
        return [x[1:] if x.startswith(" ") else x for x in texts] if self.prefix else texts


class _Memo:
    """Ids of the words seen so far: a dictionary of rows over flat arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.new: list[str] = []
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)

    def trim(self, most: int) -> None:
        """Keep the words that came back, at most ``most`` of them: those used most."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argpartition(-self.used[keep], most)[:most]])
        words, count = list(self.row), np.diff(self.offsets)[keep]      # words in the order of their rows
        self.ids = self.ids[tx.spread(self.offsets[keep], count)]
        self.offsets = np.concatenate(([0], np.cumsum(count)))
        self.row = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.used = self.used[keep] // 2        # so that words of the past can go

    def wait(self, words: set[str]) -> None:
        """Give rows to words that are still to be segmented."""
        at = len(self.row)
        self.row.update(zip(words, range(at, at + len(words))))
        self.new += words

    def settle(self, encode_words) -> None:
        if self.new:
            ids, count = encode_words(self.new)
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(count)))
            self.used = np.concatenate((self.used, np.zeros(len(count), np.int64)))
            self.new = []


def _extend(value: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hash of a string with one more character."""
    return value * U64(tx._BASE) + tx.mix64(code.astype(U64) + U64(1))


def _merge_all(text: str, rows_of: dict[str, int], time: np.ndarray) -> tuple[int, int] | None:
    """Parts of the merge that completes ``text``, or None if it stays in pieces."""
    parts = list(text)
    while len(parts) > 1:
        options = [(time[rows_of[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                   if a + b in rows_of]
        if not options:
            return None
        _, i = min(options)
        if len(parts) == 2:
            both = rows_of.get(parts[0]), rows_of.get(parts[1])
            return None if None in both else both
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return None


@functools.lru_cache(maxsize=2)
def load(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def encode_documents(docs: DataFrame, model: str, *, id_col: str = "doc_id",
                     text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: id, ids (piece ids), decoded (text of the ids), exact.

    ``exact`` tells whether decoding gives the text back; U+2581 in a text
    reads as the blank that it stands for.  No begin or end pieces are added.  A null or empty text has no ids and
    decodes to an empty text; repeated rows stay; other columns are ignored;
    an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        try:
            for batch in batches:
                for part in tx.slices(batch, "text", slice_bytes):
                    texts = [x or "" for x in part.column("text").to_pylist()]
                    ids, off = codec.encode(texts)
                    decoded = codec.decode(ids, off)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"),
                         pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())),
                         pa.array(decoded, pa.string()),
                         pa.array([a == b.replace(SPACE, " ") for a, b in zip(decoded, texts)])],
                        ["id", "ids", "decoded", "exact"])
        finally:
            codec.memo.trim(KEPT_WORDS)     # the worker lives on with other stages

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, ids array<int>, decoded string, exact boolean")
            .withColumnRenamed("id", id_col))

