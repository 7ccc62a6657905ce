"""Exact set-similarity join of texts on word shingles, by universe partition.

Two texts link when the Jaccard similarity of their sets of 5-word shingles is at
least 3/4.  The hash universe of the shingles is cut into ``m`` segments, where
``m`` depends on the size band of the sets.  Linked sets of sizes ``a <= b`` differ
in at most ``(a + b) // 7`` shingles.  So if thresholds ``v`` of 0 (skip), 1 (equal)
or 2 (equal up to one shingle) are allotted to a set's segments and their sum
exceeds that bound, then in some segment the two sets differ by less than ``v``.

* Every set posts the content of its segments under the band of its size and, as the
  larger side, under the band below; segments with ``v = 2`` also post their
  one-deletion neighbourhoods.
* Posts of one bucket meet by an equi-join on a hash; buckets of a single set are
  dropped before.
* A set's dearest segments are skipped as far as its sum allows (cost-based
  allocation), which is how passages that many texts share and empty segments never
  form pairs.
* Groups of near copies are contracted first: each set is compared with one leader,
  and later only sets of different components meet.
* Before a pair becomes a row, 2048 parity bits per set bound the difference from
  below; what remains is verified exactly on the two texts.

Sets are those of 64-bit shingle hashes; a node is a distinct set, named by a 64-bit hash of its elements.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.components import components
from corpusmill.llm.landing import land
from corpusmill.llm.segments import forget
from corpusmill.llm.shingles import mix, shingle_sets

_U = np.uint64
SKETCH_WORDS, FOLD_WORDS = 32, 8
_BITS = 64 * SKETCH_WORDS
# Roles of a post: content (indexed and probing), content (probing only), and the same of deletions.
CONTENT, PROBE, DELETION, PROBE_DELETION = 0, 1, 2, 3


def _band_tops(limit: int) -> np.ndarray:
    """Largest set size of each band: bands grow by a third, so a set links into its own band and the next."""
    tops = [0]
    while tops[-1] < limit:
        tops.append((tops[-1] + 1) * 4 // 3)
    return np.array(tops[1:], np.int64)


_TOPS = _band_tops(1 << 40)


def band_of(n: int) -> int:
    return int(np.searchsorted(_TOPS, n))


def plan_of(band: int) -> tuple[int, int]:
    """Number of segments of a band, and how many of them are matched up to one deletion."""
    need = int(_TOPS[band]) // 3 + 1
    m = need + 2 + need // 16 if need > 1 else 1
    return m, (0 if m == 1 else max(min(m, 8), m // 100))


_PLANS = np.array([plan_of(band) for band in range(len(_TOPS))], np.int64)
_GROUP_SETS, _GROUP_ELEMENTS = 256, 1 << 17


def _groups(sets: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The sets in lists of bounded length, so that numpy works on many at once; a set beyond the bound ends its list."""
    held, size = [], 0
    for u in sets:
        held.append(u)
        size += len(u)
        if len(held) == _GROUP_SETS or size > _GROUP_ELEMENTS:
            yield held
            held, size = [], 0
    if held:
        yield held


class Layout:
    """Where the elements of some sets, none of them empty, fall under the bands where the sets post.

    A set posts under its own band and, where a link of 3/4 can reach it, under the
    one below: these are its entries, all own ones first.  Cells number the segments of all entries.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.u = np.concatenate(sets)
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.first = np.cumsum(self.sizes) - self.sizes
        own = np.searchsorted(_TOPS, self.sizes)
        below = (own > 0) & (4 * _TOPS[own - 1] >= 3 * self.sizes)
        self.set = np.concatenate((np.arange(len(sets)), np.flatnonzero(below)))
        self.band = np.concatenate((own, own[below] - 1))
        m, self.doubled = _PLANS[self.band].T
        self.element = np.concatenate((np.arange(len(self.u)), np.flatnonzero(np.repeat(below, self.sizes))))
        self.entry = np.repeat(np.arange(len(self.set)), self.sizes[self.set])
        self.segment = ((self.u >> _U(20))[self.element] % m.astype(_U)[self.entry]).astype(np.int64)
        self.cell = (np.cumsum(m) - m)[self.entry] + self.segment
        self.fill = np.bincount(self.cell, minlength=int(m.sum()))
        self.filled = np.flatnonzero(self.fill)
        self.filled_entry = np.repeat(np.arange(len(m)), m)[self.filled]
        self.filled_segment = self.filled - (np.cumsum(m) - m)[self.filled_entry]

    def rooms(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the thresholds that each set's segments allow in its own band and in the one below, 0 without."""
        wide = (self.filled_segment < self.doubled[self.filled_entry]) & (self.fill[self.filled] > 1)
        n = len(self.sizes)
        room = np.bincount(self.filled_entry, 1 + wide, len(self.set)).astype(np.int64)
        below = np.zeros(n, np.int64)
        below[self.set[n:]] = room[n:]
        return room[:n], below

    def posts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures, tags (four times the segment, plus the role) and sets of all posts."""
        value = mix(self.u + _U(0x5851F42D4C957F2D))[self.element]
        content = np.zeros(len(self.fill), _U)
        np.add.at(content, self.cell, value)
        place = lambda entry, segment: mix((self.band[entry].astype(_U) << _U(40)) + segment.astype(_U) + _U(1))
        wide = np.flatnonzero((self.segment < self.doubled[self.entry]) & (self.fill[self.cell] > 1))
        entry = np.concatenate((self.filled_entry, self.entry[wide]))
        segment = np.concatenate((self.filled_segment, self.segment[wide]))
        kept = np.concatenate((content[self.filled], content[self.cell[wide]] - value[wide]))
        role = np.where(entry < len(self.sizes), CONTENT, PROBE)
        role[len(self.filled) :] += DELETION
        return mix(kept + place(entry, segment)), 4 * segment + role, self.set[entry]

    def nodes(self) -> np.ndarray:
        """Names of the sets: a 64-bit hash of all elements each."""
        return mix(np.add.reduceat(self.u, self.first) + self.sizes.astype(_U)).view(np.int64)

    def checks(self) -> np.ndarray:
        return np.add.reduceat(mix(self.u), self.first).view(np.int64)

    def sketches(self) -> np.ndarray:
        """Parity of the elements' hash in each of 2048 bits; two sets differ at least as much as their parities."""
        bit = np.repeat(np.arange(len(self.sizes)) * _BITS, self.sizes) + ((self.u >> _U(52)).astype(np.int64) & (_BITS - 1))
        odd = np.bincount(bit, minlength=len(self.sizes) * _BITS).astype(np.uint8) & 1
        return np.packbits(odd).view(np.int64)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for part in _parts(batch):
            at = 0
            for sets in _groups(shingle_sets(part.column(1).to_pylist())):
                filled = np.array([len(u) > 0 for u in sets])
                numbers = np.zeros((5, len(sets)), np.int64)
                bits = np.zeros(0, np.int64)
                if filled.any():
                    with np.errstate(over="ignore"):
                        layout = Layout([u for u in sets if len(u)])
                        numbers[:, filled] = (layout.sizes, layout.nodes(), layout.checks(), *layout.rooms())
                        bits = layout.sketches()
                ends = np.concatenate(([0], np.cumsum(filled) * SKETCH_WORDS)).astype(np.int32)
                sketches = pa.ListArray.from_arrays(pa.array(ends), pa.array(bits), mask=pa.array(~filled))
                ids = part.column(0).slice(at, len(sets))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, numbers), sketches], names=_PROFILE_NAMES)
                at += len(sets)


_PROFILE = "id bigint, n bigint, node bigint, check bigint, room_own bigint, room_below bigint, bits array<bigint>"
_PROFILE_NAMES = [part.split()[0] for part in _PROFILE.split(", ")]
_POST = "sig bigint, node bigint, tag int"
_SEEN = 1 << 18
_PART_ROWS = 512


def node_of(u: np.ndarray) -> int:
    """Name of a set: a 64-bit hash of all its elements."""
    return int(mix(u.sum(dtype=_U, keepdims=True) + _U(len(u)))[0].view(np.int64))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, of which one at a time is held as Python strings."""
    return (batch.slice(at, _PART_ROWS) for at in range(0, batch.num_rows, _PART_ROWS))


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posts of the sets; of a set that was among the last ``_SEEN`` ones of the task, none."""
    forget()
    seen: set[int] = set()
    for batch in batches:
        for part in _parts(batch):
            for sets in _groups(u for u in shingle_sets(part.column(0).to_pylist()) if len(u)):
                new: dict[int, np.ndarray] = {}
                with np.errstate(over="ignore"):
                    for u in sets:
                        if (node := node_of(u)) not in seen:
                            new.setdefault(node, u)
                    if not new:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.update(new)
                    signatures, tags, of = Layout([*new.values()]).posts()
                nodes = np.fromiter(new, np.int64, len(new))[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signatures.view(np.int64)), pa.array(nodes), pa.array(tags.astype(np.int32))], names=["sig", "node", "tag"]
                )


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``(a, b)`` whose texts reach the threshold, counted on their sets."""
    for batch in batches:
        for part in _parts(batch):
            pairs = zip(shingle_sets(part.column(2).to_pylist()), shingle_sets(part.column(3).to_pylist()), strict=True)
            keep = []
            for one, other in pairs:
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= 75 * (len(one) + len(other) - common) > 0)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(kept), part.column(1).filter(kept)], names=["a", "b"])


_FILTER_BITS = 1 << 26


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts without most of those whose id is not among ``ids``, so that little text is shuffled.

    A filter of a fixed size, 8 MB: with far more ids it passes everything, and
    costs nothing but time.
    """
    spot = F.pmod(F.xxhash64("id"), F.lit(_FILTER_BITS))
    rows = ids.select(spot.alias("spot")).selectExpr("spot >> 6 AS at", "1L << cast(spot % 64 AS int) AS bit")
    words = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(_FILTER_BITS // 64, np.int64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(2).to_numpy()
            hit = shared.value[spots >> 6] >> (spots & 63) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select([0, 1])

    return texts.select("id", "text", spot.alias("spot")).mapInArrow(keep, "id bigint, text string")


def _verified(pairs: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the ``(a, b)`` pairs of nodes whose texts link; ``heads`` has a text's id for each node."""
    named = lambda side: heads.select(F.col("node").alias(side), F.col("id").alias(f"id_{side}"))
    wanted = land(pairs.join(named("a"), "a").join(named("b"), "b"), "pairs")
    ids = wanted.select(F.col("id_a").alias("id")).unionByName(wanted.select(F.col("id_b").alias("id")))
    few = _only(texts, ids)
    told = lambda side: few.select(F.col("id").alias(f"id_{side}"), F.col("text").alias(f"text_{side}"))
    both = wanted.join(told("a"), "id_a").join(told("b"), "id_b").select("a", "b", "text_a", "text_b")
    return land(both.mapInArrow(_linked, "a bigint, b bigint"), "verified")


def _folded(profiles: DataFrame) -> DataFrame:
    """Adds the parities folded to ``FOLD_WORDS`` words, as plain columns that a join condition reads fast."""
    words = lambda j: functools.reduce(Column.bitwiseXOR, (F.col("bits")[i] for i in range(j, SKETCH_WORDS, FOLD_WORDS)))
    return profiles.withColumns({f"fold_{j}": words(j) for j in range(FOLD_WORDS)})


def _may_link(one: str, other: str) -> Column:
    """False only for sets that cannot link, by their sizes, their folded parities and their parities."""
    n_1, n_2 = F.col(f"{one}.n"), F.col(f"{other}.n")

    def difference(words: list[tuple[Column, Column]]) -> Column:
        return functools.reduce(operator.add, (F.bit_count(x.bitwiseXOR(y)) for x, y in words))

    few = difference([(F.col(f"{one}.fold_{j}"), F.col(f"{other}.fold_{j}")) for j in range(FOLD_WORDS)])
    all_ = difference([(F.col(f"{one}.bits")[i], F.col(f"{other}.bits")[i]) for i in range(SKETCH_WORDS)])
    return (4 * n_1 >= 3 * n_2) & (4 * n_2 >= 3 * n_1) & (few * 7 <= n_1 + n_2) & (all_ * 7 <= n_1 + n_2)


def _leader_pairs(alive: DataFrame) -> DataFrame:
    """Each set with the one that leads most of its buckets.

    A bucket is led by its most central set: the one whose segments are shared most.
    In a group of near copies that is the one with the fewest changes.
    """
    central = alive.groupBy("node").agg(F.sum(F.log("k")).alias("weight"))
    lead = F.max(F.struct("weight", "node")).over(Window.partitionBy("sig"))
    shared = (
        alive.join(central, "node")
        .withColumn("lead", lead)
        .select("node", F.col("lead.node").alias("b"))
        .where("node <> b")
        .groupBy("node", "b")
        .agg(F.count("*").alias("k"))
    )
    return shared.groupBy("node").agg(F.max_by("b", F.struct("k", "b")).alias("b")).select(F.col("node").alias("a"), "b")


def _chosen(posted: DataFrame) -> DataFrame:
    """The segments that cost-based allocation leaves, per node and band.

    ``posted`` holds the posts in buckets of several components, with the bucket's
    size as cost.  All other segments cost nothing and count in full.
    """
    top = F.element_at(F.array(*[F.lit(int(t)) for t in _TOPS]), F.col("band") + 1)
    doubled = F.element_at(F.array(*[F.lit(plan_of(i)[1]) for i in range(len(_TOPS))]), F.col("band") + 1)
    costs = posted.groupBy("node", "band", "seg").agg(
        F.sum("cost").alias("cost"), F.first("n").alias("n"), F.first("room").alias("room")
    )
    # Skipping a doubled segment may give up 2, also where only one of its posts is in a shared bucket.
    costs = costs.withColumn("v", F.when(F.col("seg") < doubled, 2).otherwise(1))
    spare = F.col("room") - F.floor((F.col("n") + F.least("n", top)) / 7) - 1
    dearest = Window.partitionBy("node", "band").orderBy(F.desc("cost"), "seg").rowsBetween(Window.unboundedPreceding, 0)
    return costs.withColumn("skipped", F.sum("v").over(dearest)).where(F.col("skipped") > spare).select("node", "band", "seg")


def _own_band(n: Column) -> Column:
    """Band of a size, as ``band_of``."""
    return F.size(F.filter(F.array(*[F.lit(int(t)) for t in _TOPS]), lambda top: top < n))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, n_shingles, component_id)``: links of similarity 3/4 or more, closed to components.

    Empty and null texts have no shingles and their own component.  Rows with a null
    id are left out, and an id that is repeated counts once, with its least text.
    Other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    if texts.groupBy("id").count().where("count > 1").limit(1).count():
        texts = land(texts.groupBy("id").agg(F.min("text").alias("text")), "texts")
    profiles = land(texts.mapInArrow(_profiles, _PROFILE), "profiles").withColumn("own", _own_band(F.col("n")))
    heads = land(profiles.where("n > 0").groupBy("node", "n", "check").agg(F.min("id").alias("id")), "heads")
    bucket = Window.partitionBy("sig")
    indexed = (F.col("tag") % 4).isin(CONTENT, DELETION)
    alive = land(
        texts.select("text")
        .mapInArrow(_posts, _POST)
        .withColumns(
            {
                "low": F.min("node").over(bucket),
                "high": F.max("node").over(bucket),
                "indexed": F.max(indexed).over(bucket),
                "k": F.count("*").over(bucket),
            }
        )
        .where("low < high AND indexed")
        .select("sig", "node", "tag", "k")
        .distinct(),
        "posts",
    )
    first = _verified(_leader_pairs(alive), heads, texts)
    near = components(first)
    # Buckets that still hold several components.
    labelled = alive.drop("k").join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (
        labelled.withColumns(
            {
                "cost": F.count("*").over(bucket),
                "least": F.min("component").over(bucket),
                "greatest": F.max("component").over(bucket),
            }
        )
        .where("least < greatest")
        .drop("least", "greatest")
        .withColumn("role", F.col("tag") % 4)
        .withColumn("seg", F.floor(F.col("tag") / 4))
    )
    facts = profiles.join(heads.select("id"), "id").select("node", "n", "own", "room_own", "room_below", "bits")
    below = F.col("role").isin(PROBE, PROBE_DELETION)
    mixed = land(
        mixed.join(facts.drop("bits"), "node")
        .withColumn("band", F.col("own") - below.cast("int"))
        .withColumn("room", F.when(below, F.col("room_below")).otherwise(F.col("room_own")))
        .drop("own", "room_own", "room_below", "tag"),
        "mixed",
    )
    facts = _folded(facts)
    bits = facts.select("node", "bits", *(f"fold_{j}" for j in range(FOLD_WORDS)))
    probes = mixed.join(_chosen(mixed), ["node", "band", "seg"]).join(bits, "node").alias("p")
    index = mixed.where(F.col("role").isin(CONTENT, DELETION)).join(bits, "node").alias("i")
    larger = (F.col("p.n") > F.col("i.n")) | ((F.col("p.n") == F.col("i.n")) & (F.col("p.node") > F.col("i.node")))
    met = probes.join(
        index,
        (F.col("p.sig") == F.col("i.sig"))
        & (F.col("p.component") != F.col("i.component"))
        & ((F.col("p.role") < DELETION) | (F.col("i.role") < DELETION))
        & larger
        & _may_link("p", "i"),
    ).select(F.col("p.node").alias("a"), F.col("i.node").alias("b"))
    second = _verified(met.unionByName(_short_of_room(facts)).distinct(), heads, texts)
    closed = components(first.unionByName(second)).join(heads.select("node", "id"), "node")
    least = closed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = heads.select("node", "n", "check", "id").join(
        closed.join(least, "component").select("node", "component_id"), "node", "left"
    )
    members = profiles.select(F.col("id").alias("doc"), "n", "node", "check").join(
        named.withColumnRenamed("id", "head"), ["node", "n", "check"], "left"
    )
    return members.select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "head", "doc").alias("component_id")
    )


def _short_of_room(profiles: DataFrame) -> DataFrame:
    """Pairs of the sets whose filled segments cannot reach the needed sum in a band.

    Hashing makes this practically impossible (most shingles of a set in very few
    segments), but exactness must not rest on that: they meet the whole band.
    """
    tops = F.array(*[F.lit(int(t)) for t in _TOPS])
    slim = profiles.drop("own", "room_own", "room_below")
    both = profiles.select(*slim.columns, F.col("own").alias("band"), F.col("room_own").alias("room")).unionByName(
        profiles.where("room_below > 0").select(*slim.columns, (F.col("own") - 1).alias("band"), F.col("room_below").alias("room"))
    )
    short = both.where(
        F.col("room") < F.floor((F.col("n") + F.least("n", F.element_at(tops, F.col("band") + 1))) / 7) + 1
    ).alias("p")
    return short.join(
        profiles.alias("i"),
        (F.col("p.band") == F.col("i.own"))
        & (F.col("p.node") != F.col("i.node"))
        & _may_link("p", "i"),
    ).select(F.greatest("p.node", "i.node").alias("a"), F.least("p.node", "i.node").alias("b"))


# The same rows in DuckDB SQL over ``documents`` with distinct ids, on the shingles themselves.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
      WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM words
), sizes AS (
  SELECT doc_id, count(shingle) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 75 * (s.n + t.n - c)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM words
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(other) AS component_id
FROM sizes JOIN reach ON node = doc_id GROUP BY doc_id
"""
