"""Operator 10: Jaccard join of word-shingle sets, with small and large sets joined differently.

*Equal sets* are found by a 128-bit digest, and one of them stands for all.

*Small sets* list the fixed-size subsets that a partner must share (the set without up to
``n - ceil(t n)`` members). Sets that list the same subset of a sufficient size are linked as
they stand; each is linked to the smallest of them, which keeps all of them connected.

*Large sets* scan inverted lists. A partner must share one of the first ``n - ceil(t n) + 1``
shingles in any fixed order; the order is by hash with the heavy shingles (in more than one
document of ``heavy_share``) at the end, so that common passages do not fill the lists. Lists of the
same members are one list. Each list first compares its members with one leader, in every turn another;
members whose components are then the same need no further comparison, all others meet pair by pair.
A pair goes on only if the parities of its shingles (``SKETCH_BITS`` counters modulo two a set) allow it:
each counter that differs takes a shingle that one of the sets alone has, so the number of these bounds
the difference from below and no link is lost. Every comparison is of whole sets.

The boundary between the two is the largest size whose subsets cost less than its lists, by
the sizes counted and the share of repeated shingles measured on the input.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, comb
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import materialize, ship
from regionscore.llm.components import components
from regionscore.llm.words import WordNumbers, distinct, kept, slices, windows

#: What comparing two whole sets costs, in rows of an inverted list.
COMPARISON_ROWS = 50
#: Sizes up to which subsets are considered at all.
LARGEST_SMALL = 24
#: Up to so many (member, leader) rows are broadcast to the texts (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Members of one leader that one task compares.
GROUP_ROWS = 512
#: Turns of leaders end with the first that links less than one in so many of its pairs.
FEW_LINKS = 10
#: Parities kept of each set, in columns of 64.
SKETCH_BITS = 512
SKETCH = tuple(f"s{i}" for i in range(SKETCH_BITS // 64))


def _sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle numbers, the text of each, and the size of each text's set."""
    numbers, owner = distinct(*windows(*kept("words", WordNumbers).of(texts), width))
    return numbers, owner, np.bincount(owner, minlength=len(texts))


def _parities(numbers: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Per text the parity of how many shingles fall on each of ``SKETCH_BITS`` bits, 64 bits an array; empty sets have none."""
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    column, bit = (numbers >> np.uint64(6)) % np.uint64(len(SKETCH)), np.uint64(1) << (numbers & np.uint64(63))
    out = [np.zeros(len(n), dtype=np.uint64) for _ in SKETCH]
    if len(starts):
        for i, words in enumerate(out):
            words[full] = np.bitwise_xor.reduceat(np.where(column == np.uint64(i), bit, np.uint64(0)), starts)
    return [words.view(np.int64) for words in out]


def _wide_parities(numbers: np.ndarray, n: np.ndarray) -> pa.Array:
    """The same for sets of more than ``SKETCH_BITS`` shingles, whose few parities tell nothing, on as many bits as they have shingles (a power of two); null for others."""
    out: list[np.ndarray | None] = [None] * len(n)
    starts = np.cumsum(n) - n
    for i in np.flatnonzero(n > SKETCH_BITS).tolist():
        bits = 1 << (int(n[i]).bit_length() - 1)
        odd = np.bincount((numbers[starts[i] : starts[i] + n[i]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
    return pa.array(out, pa.list_(pa.int64()))


def _apart(other: str) -> Column:
    """Shingles that at least one of two sets has alone: parities that differ from those in the columns beginning with ``other``."""
    return reduce(add, [F.bit_count(F.col(s).bitwiseXOR(F.col(f"{other}{s}"))) for s in SKETCH])


def _near(other: str, both: Column, num: int, den: int) -> Column:
    """Whether two sets of ``both`` shingles together may be similar by their parities."""
    return _apart(other) * (den + num) <= both * (den - num)


def _widely_near(x: Column, y: Column, both: Column, num: int, den: int) -> Column:
    """``_near`` by the wide parities, the longer ones folded to half their bits; true where a set has none."""
    least = F.least(F.size(x), F.size(y))

    def folded(v: Column) -> Column:
        return F.when(F.size(v) > least, F.zip_with(F.slice(v, 1, least), F.slice(v, least + 1, least), lambda p, q: p.bitwiseXOR(q))).otherwise(v)

    differ = F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(differ, F.lit(0), lambda total, one: total + one)
    return F.when(x.isNotNull() & y.isNotNull() & (F.greatest(F.size(x), F.size(y)) <= 2 * least), apart * (den + num) <= both * (den - num)).otherwise(True)


def _least(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def subset_rows(n: int, num: int, den: int) -> int:
    return sum(comb(n, d) for d in range(n - _least(n, num, den) + 1))


def boundary(sizes: dict[int, int], repeated: float, num: int, den: int) -> int:
    """The largest size up to which listing subsets is cheaper than scanning lists."""
    best, gain, total = 0, 0.0, 0.0
    for n in range(1, LARGEST_SMALL + 1):
        lists = (n - _least(n, num, den) + 1) * (1 + COMPARISON_ROWS * repeated)
        total += sizes.get(n, 0) * (lists - subset_rows(n, num, den))
        if total >= gain and lists >= subset_rows(n, num, den):
            best, gain = n, total
    return best


def _survey(docs: DataFrame, width: int, heavy_share: float) -> tuple[dict[int, int], float, np.ndarray]:
    """Numbers of small sets by size, share of repeated shingles, and the heavy shingles.

    A shingle in more than a share of all documents is in more than that share of some slice of
    them, so counts reported by slices find it; at most (mean set size / share) shingles are heavy.
    """

    def count(batches):
        for batch in batches:
            for _, texts in slices(batch.column(0).to_pylist()):
                numbers, _, n = _sets(texts, width)
                found, times = np.unique(numbers, return_counts=True)
                keep = times >= max(3, ceil(heavy_share * len(texts)))
                sizes = np.bincount(n[n <= LARGEST_SMALL], minlength=LARGEST_SMALL + 1)
                rows = [(0, np.arange(len(sizes)), sizes), (1, np.array([0, 1, 2]), np.array([len(numbers), len(found), (n > 0).sum()])), (2, found[keep].view(np.int64), times[keep])]
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(np.concatenate([np.full(len(v), k, dtype=np.int32) for k, v, _ in rows])),
                    "value": pa.array(np.concatenate([np.asarray(v, dtype=np.int64) for _, v, _ in rows])),
                    "n": pa.array(np.concatenate([np.asarray(c, dtype=np.int64) for _, _, c in rows])),
                })

    found = docs.select(F.col("text")).mapInArrow(count, "kind int, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    found = materialize(found, "survey")
    sizes = {r.value: r.n for r in found.where("kind = 0").collect()}
    totals = {r.value: r.n for r in found.where("kind = 1").collect()}
    all_shingles, distinct_in_slices, nonempty = (totals.get(i, 0) for i in range(3))
    heavy = found.where((F.col("kind") == 2) & (F.col("n") >= F.lit(max(8.0, heavy_share * nonempty)))).select("value").toArrow().column(0).to_numpy()
    return sizes, 1 - distinct_in_slices / max(1, all_shingles), np.sort(heavy.view(np.uint64))


def _prefixes(docs: DataFrame, width: int, num: int, den: int, small: int, heavy: np.ndarray) -> DataFrame:
    """Key, set size, digest and parities of the set, the shingles that a partner shares one of, and the whole set if small."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)
    schema = T.StructType([docs.schema["key"], T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("whole", T.ArrayType(T.LongType())), *(T.StructField(s, T.LongType()) for s in SKETCH), T.StructField("wide", T.ArrayType(T.LongType()))])

    def cut(batches):
        for batch in batches:
            for first, texts in slices(batch.column(1).to_pylist()):
                numbers, owner, n = _sets(texts, width)
                starts = np.cumsum(n) - n
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(numbers[s : s + k].tobytes()) for s, k in zip(starts.tolist(), n.tolist(), strict=True)), dtype="<i8").reshape(-1, 2)
                last = np.zeros(len(numbers), dtype=bool)
                if len(sent.value):
                    at = np.minimum(np.searchsorted(sent.value, numbers), len(sent.value) - 1)
                    last = sent.value[at] == numbers
                order = np.lexsort((numbers, last, owner))
                rank = np.arange(len(numbers)) - np.repeat(starts, n)
                wanted = n - -(-num * n // den) + 1
                taken = rank < np.repeat(wanted, n)
                lengths = np.bincount(owner[taken], minlength=len(texts))
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(numbers[order][taken].view(np.int64)))
                few = np.repeat(n <= small, n)
                held = np.where(n <= small, n, 0)
                whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(numbers[few].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), prefix, whole, *map(pa.array, _parities(numbers, n)), _wide_parities(numbers, n)], names=schema.names)

    return docs.select("key", "text").mapInArrow(cut, schema)


def _subsets(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between small sets: those that list the same subset, to the smallest of them."""

    def listed(batches):
        for batch in batches:
            at, keys, size = [], [], []
            for i, whole in enumerate(batch.column(1).to_pylist()):
                n = len(whole)
                for gone in range(n - _least(n, num, den) + 1):
                    for kept in combinations(whole, n - gone):
                        at.append(i)
                        keys.append(xxhash.xxh3_64_intdigest(np.array(kept, dtype="<i8").tobytes()))
                        size.append(n - gone)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([len(batch.column(1)[i]) for i in at], pa.int64()), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int64())], names=["rep", "n", "subset", "k"])

    kind = sets.schema["rep"]
    schema = T.StructType([kind, *(T.StructField(c, T.LongType()) for c in ("n", "subset", "k"))])
    rows = sets.select("rep", "whole").mapInArrow(listed, schema)
    lead = Window.partitionBy("subset", "k").orderBy("n", "rep")
    led = rows.withColumn("first", F.first(F.struct("rep", "n")).over(lead))
    enough = F.col("k") * (den + num) >= num * (F.col("n") + F.col("first.n"))
    return led.where(enough & (F.col("rep") != F.col("first.rep"))).select(F.col("first.rep").alias("a"), F.col("rep").alias("b")).distinct()


def _compare(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (leader ``a``, member ``b``) whose whole sets are similar enough.

    Texts go to their leaders' groups, hot groups in parts that each get the leader's text too.
    """
    groups = pairs.groupBy("a").agg(F.count("*").alias("members")).withColumn("parts", F.ceil(F.col("members") / GROUP_ROWS).cast("int"))
    hot = groups.where("parts > 1").select("a", "parts")
    members = pairs.join(hot, "a", "left").select("a", F.col("b").alias("key"), F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int"), F.lit(0)).alias("part"), F.lit(1).alias("role"))
    leaders = groups.select("a", F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    sent = materialize(members.unionByName(leaders), "comparisons")
    sent = F.broadcast(sent) if sent.count() <= BROADCAST_ROWS else sent
    texts = docs.join(sent, "key").select("a", "part", "role", "key", "text")
    dealt = texts.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def similar(batches):
        group, leaders_held = None, []
        for batch in batches:
            a, part, role, key = (batch.column(i).to_pylist() for i in range(4))
            at = []
            for first, some in slices(batch.column(4).to_pylist()):
                numbers, _, n = _sets(some, width)
                ends = np.cumsum(n)
                for j in range(len(some)):
                    i = first + j
                    own = numbers[ends[j] - n[j] : ends[j]]
                    if (a[i], part[i]) != group:
                        group, leaders_held = (a[i], part[i]), []
                    if role[i] == 0:
                        leaders_held.append(own)
                        continue
                    for other in leaders_held:
                        if min(len(own), len(other)) * den < num * max(len(own), len(other)):
                            continue
                        place = np.minimum(np.searchsorted(other, own), len(other) - 1)
                        shared = int((other[place] == own).sum())
                        if shared * den >= num * (len(own) + len(other) - shared):
                            at.append(i)
                            break
            found = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(found), batch.column(3).take(found)], names=["a", "b"])

    return dealt.mapInArrow(similar, schema)


def similarity_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, doc: str = "doc_id", text: str = "text", heavy_share: float = 1 / 2000, star_rounds: int = 5) -> DataFrame:
    """One row per row of ``docs``: the document, ``n_shingles`` and ``component_id``.

    Two documents link when ``den * shared >= num * union`` of their sets of ``width``-word shingles
    (words are what ASCII white space separates, A-Z in lower case; fewer words are one shingle).
    ``component_id`` is the least key that links reach. A text without words links with nothing;
    rows without a key link with nothing and have no component; rows of one key are one document,
    linked by any of its texts. Other columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col(doc).alias("key"), F.col(text).cast("binary").alias("text"))
    sizes, repeated, heavy = _survey(plain, width, heavy_share)
    small = boundary(sizes, repeated, num, den)
    sets = materialize(_prefixes(plain, width, num, den, small, heavy), "sets")
    known = sets.where((F.col("n") > 0) & F.col("key").isNotNull())
    reps = known.groupBy("d1", "d2", "n").agg(F.min("key").alias("rep"))
    chosen = known.groupBy("d1", "d2", "n").agg(F.min("key").alias("rep"), F.first("prefix").alias("prefix"), F.first("whole").alias("whole"))
    least_listed = _least(small + 1, num, den)
    inside = Window.partitionBy("h")
    lists = (
        chosen.where(F.col("n") >= least_listed)
        .select(F.posexplode("prefix").alias("at", "h"), "rep", "n")
        .withColumns({"size": F.count("*").over(inside), "list": F.bit_xor(F.xxhash64("rep")).over(inside)})
        .where("size > 1")
        .select("h", "list", "rep", "n", "at")
    )
    lists = materialize(lists, "lists")
    # a set's prefix shingles that any other set's prefix holds: no more than its prefix
    shared = materialize(lists.groupBy("rep", "n").agg(F.collect_list("h").alias("hs")), "shared")
    # shingles of one passage list the same sets; each of these lists would give the same pairs, so one stands for all,
    # from the first place of any of them (lists whose hashes agree by chance become one with the members of both)
    parities = known.where(F.col("n") >= least_listed).groupBy("d1", "d2", "n").agg(F.min("key").alias("rep"), *[F.first(s).alias(s) for s in (*SKETCH, "wide")])
    parities = materialize(parities.select("rep", *SKETCH, "wide"), "parities")
    lists = materialize(lists.groupBy("list", "rep", "n").agg(F.min("at").alias("at")).join(parities.drop("wide"), "rep"), "lists")
    links = [materialize(_subsets(chosen.where(F.col("n") <= small).select("rep", "whole"), num, den), "links")] if small else []
    for turn in range(star_rounds):
        placed = _labelled(lists, links)
        # within one size class of a list, the leader has the smallest size that may still fit
        step = F.floor(F.ln(F.col("n").cast("double")) / F.lit(float(np.log(den / num)))) if turn % 2 == 0 else F.round(F.ln(F.col("n").cast("double")) / F.lit(float(np.log(den / num))))
        order = ["n", "rep"] if turn == 0 else [F.xxhash64("rep", "list", F.lit(turn)), F.col("rep")]
        led = placed.withColumn("first", F.first(F.struct("rep", "n", "component", *SKETCH)).over(Window.partitionBy("list", step).orderBy(*order)))
        fits = (F.least("n", "first.n") * den >= F.greatest("n", "first.n") * num) & _near("first.", F.col("n") + F.col("first.n"), num, den)
        pairs = led.where((F.col("component") != F.col("first.component")) & fits).select(F.col("first.rep").alias("a"), F.col("rep").alias("b")).distinct()
        pairs = materialize(_possible(pairs, shared, num, den), "pairs")
        compared = pairs.count()
        if not compared:
            break
        new = materialize(_compare(plain, pairs, width, num, den), "links")
        links.append(new)
        # another leader a list pays while it links a good part of those it meets; what is left then meets pair by pair
        if new.count() * FEW_LINKS < compared:
            break
    placed = _labelled(lists, links)
    mixed_lists = placed.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("list")
    left = materialize(placed.join(mixed_lists, "list").join(parities.select("rep", "wide"), "rep"), "unsettled")
    one = left.select("list", F.col("rep").alias("a"), "n", F.col("component").alias("c"), "at", *SKETCH, "wide")
    two = left.select(F.col("list").alias("same"), F.col("rep").alias("b"), F.col("n").alias("m"), F.col("component").alias("e"), F.col("at").alias("to"), *[F.col(s).alias(f"other_{s}") for s in SKETCH], F.col("wide").alias("other_wide"))
    # in the list of the first shingle that two sets share, what follows it must suffice
    enough = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) * (den + num) >= num * (F.col("n") + F.col("m"))
    near = _near("other_", F.col("n") + F.col("m"), num, den) & _widely_near(F.col("wide"), F.col("other_wide"), F.col("n") + F.col("m"), num, den)
    rest = one.join(two, (F.col("list") == F.col("same")) & (F.col("a") < F.col("b")) & (F.col("c") != F.col("e")) & enough & near).select("a", "b").distinct()
    rest = materialize(_possible(rest, shared, num, den), "pairs")
    if not rest.isEmpty():
        links.append(materialize(_compare(plain, rest, width, num, den), "links"))
    if not links:
        links.append(lists.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0))
    classes = components(_all(links))
    by_set = reps.join(classes, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    same_key = known.select("key", "d1", "d2", "n").join(by_set, ["d1", "d2", "n"]).groupBy("key").agg(F.min("component_id").alias("component_id"))
    return (
        sets.select("key", "n")
        .join(same_key, "key", "left")
        .select(F.col("key").alias(doc), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
    )


def _possible(pairs: DataFrame, shared: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose prefixes share enough for the whole sets to be similar.

    The prefix that ends first holds all shared shingles up to its end; beyond it a set of ``n`` has
    ``ceil(t n) - 1`` more.
    """
    one = shared.select(F.col("rep").alias("a"), F.col("n").alias("n"), F.col("hs").alias("x"))
    two = shared.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("hs").alias("y"))
    beyond = F.ceil(F.greatest("n", "m") * num / den) - 1
    most = F.size(F.array_intersect("x", "y")) + beyond
    return pairs.join(one, "a").join(two, "b").where(most * (den + num) >= num * (F.col("n") + F.col("m"))).select("a", "b").distinct()


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _labelled(lists: DataFrame, links: list[DataFrame]) -> DataFrame:
    """List members with the component that the links so far put them in."""
    if not links:
        return lists.withColumn("component", F.col("rep"))
    classes = components(_all(links))
    return lists.join(classes, F.col("rep") == F.col("node"), "left").select("list", "rep", "n", "at", *SKETCH, F.coalesce("component", "rep").alias("component"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document has the least key of its class; rows without a key stay."""
    classes = materialize(similarity_classes(docs, width, num, den, doc, text), "classes")
    gone = classes.where(F.col(doc) != F.col("component_id")).select(F.col(doc).alias("_gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, F.col(doc) == F.col("_gone"), "left_anti")
