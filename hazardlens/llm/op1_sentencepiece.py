"""SentencePiece encoding and decoding with N-best segmentation.

The pieces and scores of a public SentencePiece model span a lattice over
the text. Forward Viterbi scores give each position the best score of any
segmentation up to it; they are exact heuristics for an A* search that runs
backward from the end, so paths leave the queue in the order of their scores.

No piece crosses a word's start, a line end or a change between letters and
other characters (checked when the model is read), so the lattice falls into
independent parts. The forward pass runs over all new distinct parts of a
block of texts at once, one length after the other, and also gives each
part's second-best score; words keep their result while they fit in a bounded
cache. The best alternatives of a text are the best sums of its words'
alternatives, and only words that differ in one of them are searched.

Characters without a piece become their UTF-8 byte pieces. One blank is put
before the text, blanks are part of pieces, and nothing else is normalised:
decoding gives the text back exactly, a literal U+2581 included. Null counts
as empty; an empty text has no pieces and one segmentation of score 0. Ties
are settled the same way in every run. Very long texts and words are encoded
whole. An empty table gives an empty result; extra columns are dropped.

``decoded`` turns any table of ids back into texts and keeps the table's other
columns. Null ids give a null text; an id that the model lacks is an error.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, slices, small_batches, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
BLOCK_CHARS = 1_000_000   # characters whose parts are solved together; a longer text is a block of its own
VECTOR_PARTS = 48         # as many parts of one length or more are solved together
VECTOR_LENGTH = 32        # up to this length
CACHED_WORDS = 150_000    # words whose segmentation a task keeps
CACHED_SEARCHES = 20_000  # words whose alternatives a task keeps
UNKNOWN_PENALTY = 10.0
DECODED_ROWS = 1000       # rows decoded together

# A part: blanks and letters, blanks and other characters, a line end, or blanks alone.
PART = re.compile(r" *(?:[^\W\d_²]+|(?:[\d_²]|[^\w \n])+)|\n| +")
SPACED = re.compile(r" +[^ ]*")


_BASE = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _piece_bytes(sp) -> list[bytes]:
    """The UTF-8 bytes that each id stands for."""
    raw = []
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            raw.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            raw.append(b"")
        else:
            raw.append(piece.replace("▁", " ").encode())
    return raw


class PieceModel:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.raw = _piece_bytes(sp)
        self.raw_sizes = np.array(list(map(len, self.raw)), np.int64)
        self.byte_ids = [0] * 256
        for i, raw in enumerate(self.raw):
            if sp.is_byte(i):
                self.byte_ids[raw[0]] = i
            elif raw:
                self.ids[raw.decode()] = i
                self.scores[raw.decode()] = sp.get_score(i)
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        # Slots of a hash table over the pieces, for whole arrays of substrings.
        by_id = {i: p for p, i in self.ids.items()}
        self.score_of = np.array([self.scores.get(by_id.get(i, ""), -np.inf) for i in range(sp.vocab_size())] + [-np.inf])
        self.slots = np.zeros(1 << 20, np.uint64)
        self.slot_ids = np.full(1 << 20, -1, np.int32)
        beginnings = {p[:k] for p in self.ids for k in range(1, len(p))} - self.ids.keys()
        for piece, i in chain(self.ids.items(), ((x, -2) for x in sorted(beginnings))):
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
            at = (h * int(_SPREAD) & ((1 << 64) - 1)) >> 44
            while self.slot_ids[at] != -1:
                at = (at + 1) & 0xFFFFF
            self.slots[at], self.slot_ids[at] = h, i
        crossing = [p for p in self.ids if len(PART.findall(p)) != 1]
        if crossing:
            raise ValueError(f"pieces cross part boundaries: {crossing[:5]}")


    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; -2 for a beginning of a piece
        that is no piece itself, -1 for anything else."""
        at = (hashes * _SPREAD) >> np.uint64(44)
        found = self.slot_ids[at]
        other = np.flatnonzero((self.slots[at] != hashes) & (found != -1))
        while len(other):
            at[other] = (at[other] + np.uint64(1)) & np.uint64(0xFFFFF)
            found[other] = self.slot_ids[at[other]]
            other = other[(self.slots[at[other]] != hashes[other]) & (found[other] != -1)]
        return found


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


Path = tuple[float, tuple[int, ...]]  # score, ids


class Segmenter:
    def __init__(self, model: PieceModel):
        self.m = model
        self.searched: dict[tuple[str, int], list[Path]] = {}
        self.unsound: set[tuple[str, int]] = set()  # searches with ids that do not decode to their part
        self._forget()

    def _forget(self) -> None:
        """Empty the cache of words: their numbers, ids, scores, losses, and
        whether the ids decode to the word."""
        self.words: dict[str, int] = {}
        self.names: list[str] = []
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.scores = self.lost = np.zeros(0)
        self.sound = np.zeros(0, bool)

    def forward(self, part: str) -> tuple[list[float], list[float], list[int]]:
        """Best and second-best score up to each position, and where the best piece begins."""
        scores, longest, unknown = self.m.scores, self.m.longest, self.m.unknown
        best, second, back = [0.0], [-np.inf], [0]
        for end in range(1, len(part) + 1):
            b1 = b2 = -np.inf
            at = end - 1
            for start in range(max(0, end - longest), end):
                s = scores.get(part[start:end])
                if s is None:
                    if start < end - 1:
                        continue
                    s = unknown
                v = best[start] + s
                if v > b1:
                    b1, b2, at = v, b1, start
                elif v > b2:
                    b2 = v
                v = second[start] + s
                if v > b2:
                    b2 = v
            best.append(b1)
            second.append(b2)
            back.append(at)
        return best, second, back

    def _emit(self, piece: str) -> tuple[int, ...]:
        i = self.m.ids.get(piece)
        return (i,) if i is not None else tuple(self.m.byte_ids[b] for b in piece.encode())

    def solve(self, part: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best path and how much worse the second is."""
        best, second, back = self.forward(part)
        cuts = [len(part)]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        ids = tuple(chain.from_iterable(self._emit(part[a:b]) for a, b in zip(cuts, cuts[1:])))
        return ids, best[-1], best[-1] - second[-1]

    def n_best(self, part: str, n: int) -> list[Path]:
        """The ``n`` best paths: A* backward from the end; the forward score of
        the position reached is the exact best completion."""
        best, _, _ = self.forward(part)
        scores, longest, unknown = self.m.scores, self.m.longest, self.m.unknown
        queue = [(-best[-1], 0, len(part), 0.0, None)]
        pushed, out = 0, []
        while queue and len(out) < n:
            _, _, at, done, tail = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((done, tuple(ids)))
                continue
            for start in range(max(0, at - longest), at):
                piece = part[start:at]
                s = scores.get(piece)
                if s is None:
                    if start < at - 1:
                        continue
                    s = unknown
                pushed -= 1  # of equal paths the one reached last goes first: depth before breadth
                heapq.heappush(queue, (-(done + s + best[start]), pushed, start, done + s, (self._emit(piece), tail)))
        return out

    def solve_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``solve`` for distinct parts: all ids, where each part's ids begin
        (one entry more than parts), scores, and losses of the second paths."""
        solved = []  # (part numbers, their ids, ids per part)
        scores, losses = np.empty(len(parts)), np.empty(len(parts))
        lengths: dict[int, list[int]] = {}
        for k, p in enumerate(parts):
            lengths.setdefault(len(p), []).append(k)
        for length, group in lengths.items():
            left = group
            if len(group) >= VECTOR_PARTS and length <= VECTOR_LENGTH:
                got, sizes, best, loss, known = self._solve_length([parts[k] for k in group], length)
                at = np.array(group)
                scores[at], losses[at] = best, loss
                solved.append((at[known], got[np.repeat(known, sizes)], sizes[known]))
                left = at[~known].tolist()
            ids = []
            for k in left:
                found, scores[k], losses[k] = self.solve(parts[k])
                ids.append(found)
            solved.append((np.array(left, np.int64), np.fromiter(chain.from_iterable(ids), np.int32), np.array(list(map(len, ids)), np.int64)))
        counts = np.zeros(len(parts), np.int64)
        for at, _, sizes in solved:
            counts[at] = sizes
        starts = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(starts[-1], np.int32)
        for at, got, sizes in solved:
            flat[_ragged(starts[at], sizes)] = got
        return flat, starts, scores, losses

    def _solve_length(self, parts: list[str], length: int):
        """The forward pass for parts of one length, and the best paths' ids,
        one part after the other, with the number of each part's ids. ``known`` is False for parts with characters that no piece has."""
        n = len(parts)
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).reshape(n, length).T.astype(np.uint64) + np.uint64(1)
        best = np.full((length + 1, n), -np.inf)
        second = np.full((length + 1, n), -np.inf)
        back = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)
        best[0] = 0.0
        known = np.ones(n, bool)
        for start in range(length):
            h = np.zeros(n, np.uint64)
            rows = np.arange(n)  # whose substring from here is still the beginning of a piece
            for end in range(start + 1, min(length, start + self.m.longest) + 1):
                h = h * _BASE + codes[end - 1][rows]
                i = self.m.look_up(h)
                if end == start + 1:
                    known &= i >= 0
                on = i != -1
                if not on.any():
                    break
                if 4 * on.sum() < 3 * len(on):
                    rows, h, i = rows[on], h[on], i[on]
                hit = np.flatnonzero(i >= 0)
                r, i = rows[hit], i[hit]
                s = self.m.score_of[i]
                v, w, was = best[start][r] + s, second[start][r] + s, best[end][r]
                second[end][r] = np.maximum(np.maximum(second[end][r], np.minimum(v, was)), w)
                better = v > was
                r = r[better]
                best[end][r] = v[better]
                back[end][r] = start
                piece[end][r] = i[better]
        rows, at, steps = np.arange(n), np.full(n, length), []
        while (at > 0).any():
            steps.append(np.where(at > 0, piece[at, rows], -1))
            at = np.where(at > 0, back[at, rows], 0)
        ids = np.stack(steps[::-1], axis=1)
        taken = ids >= 0
        with np.errstate(invalid="ignore"):
            return ids[taken], taken.sum(1), best[length], best[length] - second[length], known

    def _losses(self, part: str, chosen: tuple[int, ...], score: float, n: int) -> list[Path]:
        """Losses and ids of a part's best paths; the path that the forward
        pass chose among equals is the first."""
        key = (part, n)
        if key not in self.searched:
            if len(self.searched) >= CACHED_SEARCHES:
                self.searched.clear()
                self.unsound.clear()
            rest = [p for p in self.n_best(part, n) if p[1] != chosen]
            self.searched[key] = [(0.0, chosen)] + [(score - s, ids) for s, ids in rest[:n - 1]]
            raw = self.m.raw
            if any(b"".join(map(raw.__getitem__, ids)) != part.encode() for _, ids in self.searched[key]):
                self.unsound.add(key)
        return self.searched[key]

    def split(self, text: str) -> list[str]:
        """The words of blank + text, each without the one blank before it."""
        if not text:
            return []
        if "  " in text or text[0] == " ":
            return [w[1:] for w in SPACED.findall(" " + text)]
        return text.split(" ")

    def learn(self, words: list[str]) -> None:
        """Solve new words; a word's lattice is a chain of independent parts."""
        made, counts = [], []
        for w in words:
            found = PART.findall(" " + w)
            counts.append(len(found))
            made += found
        parts = dict.fromkeys(made)
        for k, p in enumerate(parts):
            parts[p] = k
        flat, starts, scores, losses = self.solve_many(list(parts))
        counts = np.array(counts, np.int64)
        at = np.fromiter(map(parts.__getitem__, made), np.int64, len(made))
        firsts = np.cumsum(counts) - counts
        sizes = np.diff(starts)[at]
        ids = flat[_ragged(starts[at], sizes)]
        known = len(self.names)
        self.words.update(zip(words, range(known, known + len(words))))
        self.names += words
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.add.reduceat(sizes, firsts))])
        self.flat = np.concatenate([self.flat, ids])
        self.scores = np.concatenate([self.scores, np.add.reduceat(scores[at], firsts)])
        self.lost = np.concatenate([self.lost, np.minimum.reduceat(losses[at], firsts)])
        self.sound = np.concatenate([self.sound, self._decode_to(words, ids, np.add.reduceat(sizes, firsts))])

    def _decode_to(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each word's ids, ``sizes`` of them, decode to blank + word."""
        raw = self.m.raw
        ends = np.cumsum(sizes)
        lengths = np.add.reduceat(self.m.raw_sizes[ids], ends - sizes)
        want = [f" {w}".encode() for w in words]
        if lengths.tolist() == list(map(len, want)) and b"".join(map(raw.__getitem__, ids.tolist())) == b"".join(want):
            return np.ones(len(words), bool)
        found = (b"".join(map(raw.__getitem__, ids[e - s:e].tolist())) for e, s in zip(ends.tolist(), sizes.tolist()))
        return np.array([a == b for a, b in zip(found, want)], bool)

    def encode_block(self, texts: list[str], n: int = 1) -> list[list[tuple[float, np.ndarray]]]:
        """For each text its ``n`` best segmentations, best first (fewer if there are fewer)."""
        return [paths for paths, _ in self.checked_block(texts, n)]

    def checked_block(self, texts: list[str], n: int = 1) -> list[tuple[list[tuple[float, np.ndarray]], bool]]:
        """``encode_block`` with, for each text, whether all its segmentations
        decode to it. A segmentation is the ids of the text's words in order,
        so it does if each word's ids decode to the word and the words make up
        the text; words are decoded once, when they are solved or searched."""
        split = [self.split(t) for t in texts]
        if len(self.names) > CACHED_WORDS:
            self._forget()
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.words]
        if new:
            self.learn(new)
        out = []
        for text, words in zip(texts, split):
            at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            sizes = self.starts[at + 1] - self.starts[at]
            ids = self.flat[_ragged(self.starts[at], sizes)]
            score = float(self.scores[at].sum())
            more, sound = self._alternatives(at, np.cumsum(sizes), ids, score, n) if n > 1 and words else ([], True)
            out.append(([(score, ids)] + more, bool(sound and self.sound[at].all() and " ".join(words) == text)))
        return out

    def _alternatives(self, at, ends, ids, score, n):
        # A segmentation among the n best differs only in words with the n - 1 smallest losses.
        loss = self.lost[at]
        near = np.argpartition(loss, n - 2)[:n - 1] if len(loss) >= n else np.arange(len(loss))
        near = [int(k) for k in near[np.lexsort((near, loss[near]))] if loss[k] < np.inf]
        own = lambda k: self.flat[self.starts[at[k]]:self.starts[at[k] + 1]]
        options = [self._losses(" " + self.names[at[k]], tuple(own(k).tolist()), float(self.scores[at[k]]), n) for k in near]
        chosen, seen, queue = [], set(), [(0.0, (0,) * len(near))]
        while queue and len(chosen) < n:
            lost, choice = heapq.heappop(queue)
            if choice in seen:
                continue
            seen.add(choice)
            chosen.append((lost, choice))
            for j in range(len(choice)):
                if choice[j] + 1 < len(options[j]):
                    worse = options[j][choice[j] + 1][0] - options[j][choice[j]][0]
                    heapq.heappush(queue, (lost + worse, choice[:j] + (choice[j] + 1,) + choice[j + 1:]))
        result = []
        for lost, choice in chosen[1:]:
            pieces, upto = [], 0
            for k, alternative in sorted((near[j], options[j][c][1]) for j, c in enumerate(choice) if c):
                first = int(ends[k]) - len(own(k))
                pieces += [ids[upto:first], np.array(alternative, np.int32)]
                upto = int(ends[k])
            result.append((score - lost, np.concatenate(pieces + [ids[upto:]])))
        return result, not any((" " + self.names[at[k]], n) in self.unsound for k in near)

    def encode(self, text: str | None, n: int = 1) -> list[Path]:
        return [(s, tuple(ids.tolist())) for s, ids in self.encode_block([text or ""], n)[0]]

    def decode(self, ids) -> str:
        return b"".join(map(self.m.raw.__getitem__, ids))[1:].decode()


_IDS = T.ArrayType(T.IntegerType())
_FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_best_ids", T.ArrayType(_IDS)),
    T.StructField("n_best_scores", T.ArrayType(T.DoubleType())), T.StructField("n_best_sha256", T.StringType()),
    T.StructField("round_trip", T.BooleanType()),
])


def _blocks(texts: list[str]):
    """Ranges of texts of about ``BLOCK_CHARS`` together."""
    first = size = 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > BLOCK_CHARS:
            yield first, k
            first, size = k, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def _lists(values: pa.Array, sizes: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values).cast(kind)


def _decode(raw: list[bytes], lists: pa.Array) -> list[str | None]:
    """The text of each list of ids, None for null."""
    flat = lists.flatten()
    if flat.null_count:
        flat = flat.fill_null(raw.index(b""))
    flat = flat.to_numpy(zero_copy_only=False)
    if len(flat) and not 0 <= flat.min() <= flat.max() < len(raw):
        raise ValueError("ids without a piece in the model")
    out, at = [], 0
    for size in lists.value_lengths().to_pylist():
        if size is None:
            out.append(None)
        else:
            joined = b"".join(map(raw.__getitem__, flat[at:at + size].tolist()))
            out.append(joined.removeprefix(b" ").decode(errors="replace"))
            at += size
    return out


def decoded(rows: DataFrame, ids: str = "ids", into: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """All rows and columns with ``into``, the text of the piece ids in the
    column ``ids`` (array<int>), or the texts of several lists (array<array<int>>)."""
    several = isinstance(rows.schema[ids].dataType.elementType, T.ArrayType)
    kind = T.ArrayType(T.StringType()) if several else T.StringType()
    schema = T.StructType([f for f in rows.schema if f.name != into] + [T.StructField(into, kind)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import sentencepiece
        raw = _piece_bytes(sentencepiece.SentencePieceProcessor(model_file=model_path))

        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                b = batch.slice(at, DECODED_ROWS)
                lists = b.column(ids)
                if several:
                    sizes = lists.value_lengths().fill_null(0).to_pylist()
                    found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()),
                                                     pa.array(_decode(raw, lists.flatten()), pa.string()), mask=lists.is_null())
                else:
                    found = pa.array(_decode(raw, lists), pa.string())
                yield pa.RecordBatch.from_arrays([(found if f.name == into else b.column(f.name)).cast(f.type) for f in arrow],
                                                 schema=arrow)

    return rows.mapInArrow(run, schema)


def encoded(docs: DataFrame, model_path: str = MODEL_PATH, n: int = N_BEST) -> DataFrame:
    """Per row: ids of the best segmentation, ids, scores, lengths and a digest
    of the ``n`` best, and whether all of them decode to the text."""
    arrow = to_arrow_schema(_FOUND)
    small_batches(docs.sparkSession)

    def run(batches):
        seg = Segmenter(PieceModel(model_path))
        gc.set_threshold(200_000)  # its caches are large and hold no cycles
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _blocks(texts):
                checked = seg.checked_block(texts[a:b], n)
                found = [paths for paths, _ in checked]
                sizes = list(map(len, found))
                paths = [ids for x in found for _, ids in x]
                inner = _lists(pa.array(np.concatenate(paths), pa.int32()), list(map(len, paths)), arrow.field(1).type.value_type)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), _lists(inner, sizes, arrow.field(1).type),
                    _lists(pa.array([s for x in found for s, _ in x], pa.float64()), sizes, arrow.field(2).type),
                    pa.array([hashlib.sha256(b"".join(ids.astype("<i4").tobytes() + b"|" for _, ids in x)).hexdigest()
                              for x in found], pa.string()),
                    pa.array([sound for _, sound in checked], pa.bool_())],
                    schema=arrow)
        seg = found = checked = paths = inner = texts = None
        give_back()

    found = docs.select("doc_id", "text").mapInArrow(run, _FOUND)
    best = F.element_at("n_best_ids", 1)
    return found.select("doc_id", F.size(best).cast("long").alias("n_pieces"), best.alias("ids"),
                        F.element_at("n_best_scores", 1).alias("score"), "n_best_ids", "n_best_scores",
                        F.transform("n_best_ids", F.size).alias("n_best_pieces"), "n_best_sha256", "round_trip")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
