"""Operator 13: which tokens of two tokenizers lie over the same bytes, by interval coalescing.

Both token lists of a text tile its bytes. All tokens are sorted by where they start; the running maximum of
their ends says how far the tokens so far reach, and a group ends where the next token starts at
that mark: there a token of both lists ends. Within a group every pair of overlapping tokens is a link.

A text is cut before the single spaces that lie between other characters: neither tokenizer forms
a token across them, so the cuts are ends in both lists, and a worker aligns each distinct part once
while it remembers it. Parts with other white space are kept whole; a text whose pieces do not give its bytes
back is tokenized as a whole, and has no tokens if that does not either.

How often a pair of ids is linked in the whole corpus is counted relationally: a chunk of documents lists
its distinct pairs, so a frequent pair is one row a chunk; their sums by pair, and the largest sum
of each B id, are joined back to the chunks, which hold the pairs of each document as places in that list.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import key_name, materialize, ship
from regionscore.llm.tokenizing import _byte_letters, tokenizer
from regionscore.llm.words import kept

#: Text of one chunk, about, and of one step inside it; a longer text is a chunk and a step of its own.
CHUNK_BYTES = 8_000_000
STEP_BYTES = 500_000
MOST_CACHED, LONGEST_CACHED = 120_000, 64
#: A single space between characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


def coalesced(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and every B interval; groups touch no interval of another group."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.zeros(len(order), dtype=np.int64)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new)
    return group[: len(a_start)], group[len(a_start) :]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A, B) of intervals that share a byte; each list in order and without overlaps of its own."""
    first = np.searchsorted(b_end, a_start, side="right")
    number = np.searchsorted(b_start, a_end, side="left") - first
    a = np.repeat(np.arange(len(a_start)), number)
    b = np.arange(len(a)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
    return a, b


class Aligner:
    """Aligned parts of texts, remembered up to a bound."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = tokenizer(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in enumerate(_byte_letters())}
        vocabulary = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in (vocabulary.get(i, "") for i in range(max(vocabulary) + 1))]
        self.b_bytes = [self._b_bytes(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        if len(self.a_bytes) > 1 << 16:
            raise ValueError("ids of tokenizer A take more than 16 bits")
        # the text of a token with what follows it, by id: inside and at the end of its side of a group
        self.words = [f"{i}{c}" for n, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for c in marks for i in range(n)]
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def _b_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def parts(self, text: str) -> list[str]:
        """What ``" " + text`` consists of, each part without the space that it begins with."""
        parts = text.split(" ")
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts if p not in self.known):
            return CUT.split(text)
        return parts

    def learn(self, parts: set[str]) -> None:
        """Align what is not known. When the table is full it becomes the one before, from which what is met again is taken over."""
        if len(self.known) + len(parts) > MOST_CACHED:
            self.before, self.known = self.known, {}
        new = parts - self.known.keys()
        again = new & self.before.keys()
        self.known.update((p, self.before[p]) for p in again)
        if new := new - again:
            listed = sorted(new)
            self.known.update(zip(listed, self.align(listed), strict=True))

    def forget(self, parts: set[str]) -> None:
        """Long parts, and parts that the plain split may not meet, are not remembered."""
        for p in parts:
            if len(p) > LONGEST_CACHED or not p or p[0].isspace() or p[-1].isspace():
                self.known.pop(p, None)

    def align(self, parts: list[str]) -> list[tuple | None]:
        """For each part: numbers of A and B tokens and groups, its links as ``b << 16 | a``, its groups as text."""
        a_ids = [e.ids for e in self.a.encode_batch([" " + p for p in parts], add_special_tokens=False)]
        b_ids = self.b.encode(parts, num_threads=1)
        raw = [(" " + p).encode() for p in parts]
        a_n, b_n, size = (np.fromiter(map(len, x), dtype=np.int64, count=len(parts)) for x in (a_ids, b_ids, raw))
        a, b = (np.fromiter(chain.from_iterable(x), dtype=np.int64, count=int(n.sum())) for x, n in ((a_ids, a_n), (b_ids, b_n)))
        fine = self._gives(a, a_n, self.a_size, self.a_bytes, raw, size) & self._gives(b, b_n, self.b_size, self.b_bytes, raw, size)
        if not fine.all():
            a, b = a[np.repeat(fine, a_n)], b[np.repeat(fine, b_n)]
            a_n, b_n = a_n * fine, b_n * fine
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])  # the parts one after another
        a_start, b_start = a_end - self.a_size[a], b_end - self.b_size[b]
        a_group, b_group = coalesced(a_start, a_end, b_start, b_end)
        link_a, link_b = overlaps(a_start, a_end, b_start, b_end)
        links = (b[link_b] << 16 | a[link_a]).astype("<u4").tobytes()
        a_last, b_last = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (a_group, b_group))
        index = np.concatenate([a + a_last * len(self.a_bytes), 2 * len(self.a_bytes) + b + b_last * len(self.b_bytes)])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        text = [self.words[i] for i in index[order].tolist()]
        a_to, b_to = np.cumsum(a_n), np.cumsum(b_n)
        link_to = 4 * np.searchsorted(link_a, a_to)
        group_to = np.append(a_group + 1, 0)[a_to - 1]  # parts without tokens at the beginning get the 0
        rows = zip(fine.tolist(), a_n.tolist(), b_n.tolist(), np.diff(group_to, prepend=0).tolist(), link_to.tolist(), (a_to + b_to).tolist(), strict=True)
        out: list[tuple | None] = []
        link, token = 0, 0
        for ok, n_a, n_b, groups, link_end, token_end in rows:
            out.append((n_a, n_b, groups, links[link:link_end], "".join(text[token:token_end])[:-1]) if ok else None)
            link, token = link_end, token_end
        return out

    @staticmethod
    def _gives(ids: np.ndarray, number: np.ndarray, sizes: np.ndarray, table: list[bytes], raw: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether the tokens of each part give its bytes."""
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])
        to = np.cumsum(number)
        same = ends[to] - ends[to - number] == size
        joined = [table[i] for i in ids.tolist()]
        if same.all() and b"".join(joined) == b"".join(raw):
            return same
        return same & np.array([b"".join(joined[t - n : t]) == r for t, n, r in zip(to.tolist(), number.tolist(), raw, strict=True)], dtype=bool)

    def of(self, text: str | None, parts: list[str]) -> tuple[int, int, int, bytes, str]:
        """The whole text; nothing where the tokens do not give its bytes back."""
        if not text:
            return 0, 0, 0, b"", ""
        found = [self.known[p] for p in parts]
        if None in found:
            found = self.align([text])
            if found[0] is None:
                return 0, 0, 0, b"", ""
        a, b, groups, links, texts = zip(*found, strict=True)
        return sum(a), sum(b), sum(groups), b"".join(links), ";".join(texts)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 byte by byte: their leading bytes are mostly 0 and pack well."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per chunk: its documents' numbers, its distinct pairs with how often it holds each, and
    for each document the places of its pairs in that list (as steps) and how often it holds them."""
    key = docs.schema["key"].dataType
    long = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(key)), T.StructField("n_a", long), T.StructField("n_b", long), T.StructField("n_groups", long),
        T.StructField("n_links", long), T.StructField("digests", T.ArrayType(T.StringType())), T.StructField("pairs", long), T.StructField("times", long),
        T.StructField("sizes", T.BinaryType()), T.StructField("steps", T.BinaryType()), T.StructField("held", T.BinaryType()),
    ])

    def whole(values, kind) -> pa.ListArray:
        flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

    def chunked(number: int, keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        codes = [np.unique(np.frombuffer(r[3], "<u4"), return_counts=True) for r in rows]
        everything, held = np.concatenate([c for c, _ in codes]), np.concatenate([n for _, n in codes])
        pairs, place = np.unique(everything, return_inverse=True)
        sizes = np.array([len(c) for c, _ in codes])
        steps = np.diff(place, prepend=0)
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        steps[firsts] = place[firsts]
        times = np.bincount(place, weights=held, minlength=len(pairs)).astype(np.int64)
        columns = [whole([r[i] for r in rows], pa.int64()) for i in range(3)]
        links = whole([len(r[3]) // 4 for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), whole(keys, None), *columns, links, whole([r[4] for r in rows], pa.string()), whole(pairs.astype(np.int64), pa.int64()), whole(times, pa.int64())]
            + [pa.array([_packed(x)], pa.binary()) for x in (sizes, steps, held)],
            names=schema.names,
        )

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        aligner = kept(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))
        keys, rows, size = [], [], 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            first = 0
            while first < len(texts):
                end, step = first, 0
                while end < len(texts) and step < STEP_BYTES:
                    step += len(texts[end] or "")
                    end += 1
                parts = [aligner.parts(t) if t else [] for t in texts[first:end]]
                distinct = set().union(*parts)
                aligner.learn(distinct)
                for t, p in zip(texts[first:end], parts, strict=True):
                    a, b, groups, links, text = aligner.of(t, p)
                    rows.append((a, b, groups, links, hashlib.sha256(text.encode()).hexdigest() if text else ""))
                aligner.forget(distinct)
                keys.append(batch.column(0).slice(first, end - first))
                size, first = size + step, end
                if size >= CHUNK_BYTES:
                    yield chunked(number, pa.concat_arrays(keys), rows)
                    keys, rows, size, number = [], [], 0, number + 1
        if rows:
            yield chunked(number, pa.concat_arrays(keys), rows)

    return docs.select("key", "text").mapInArrow(cut, schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Each linked pair of ids (``pair`` = B id * 65536 + A id): its links in the corpus, and whether no other A id has more with that B id."""
    listed = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("z")).select(F.col("z.pairs").alias("pair"), F.col("z.times").alias("n"))
    totals = materialize(listed.groupBy("pair").agg(F.sum("n").alias("total")), "pair_totals")
    b_id = F.shiftright("pair", 16)
    most = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("most"))
    return totals.join(most, b_id == F.col("b_id")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the document and the alignment of tokenizer A's and B's tokens of its text.

    Columns: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair has the most links in the corpus of all with
    that B id, ties included), ``count_sum`` (of the corpus counts of its links' pairs) and ``groups_sha256``.

    No text and an empty text have no tokens: zeros and an empty digest; so has a text that B changes.
    Special-token strings are plain text. Equal rows, and rows without a key, are documents of their own and
    count as such. A very long text is a chunk of its own. Other columns are not read; a key column that bears the
    name of an output column is returned with ``key_`` before its name. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col(doc).alias("key"), F.col(text).cast("string").alias("text"))
    chunks = materialize(_chunks(plain, a_path, b_path), "aligned_chunks")
    listed = chunks.select(F.col("chunk").alias("in_chunk"), F.posexplode("pairs").alias("place", "pair"))
    counts = listed.join(pair_counts(chunks), "pair").select("in_chunk", "place", "total", "best")
    key = plain.schema["key"].dataType
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([T.StructField(key_name(doc, [*longs, "groups_sha256"]), key), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups_sha256", T.StringType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c).combine_chunks() for c in left.column_names}
        total, best = np.zeros(right.num_rows, dtype=np.int64), np.zeros(right.num_rows, dtype=np.int64)
        place = right.column("place").to_numpy()
        total[place], best[place] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sizes, steps, held = (_unpacked(row[c][0].as_py()) for c in ("sizes", "steps", "held"))
        # steps run on from the first place of each document
        walked = np.cumsum(steps)
        firsts = np.cumsum(sizes) - sizes
        before = np.where(firsts > 0, walked[np.maximum(firsts - 1, 0)], 0) if len(walked) else firsts
        at = walked - np.repeat(before, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n_best, count_sum = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        np.add.at(n_best, owner, held * best[at])
        np.add.at(count_sum, owner, held * total[at])
        flat = {c: row[c].flatten() for c in ("keys", "n_a", "n_b", "n_groups", "n_links", "digests")}
        return pa.Table.from_arrays(
            [flat["keys"], flat["n_a"], flat["n_b"], flat["n_groups"], flat["n_links"], pa.array(n_best), pa.array(count_sum), flat["digests"]], names=schema.names
        )

    whole = chunks.drop("pairs", "times")
    return whole.groupBy("chunk").cogroup(counts.groupBy("in_chunk")).applyInArrow(score, schema)
