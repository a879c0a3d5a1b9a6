"""Near-duplicate groups: SuperMinHash sketches, banding, verification on whole sets, union-find.

SuperMinHash draws for every element a random permutation of the sketch's slots, and in step j offers j plus a fraction to
the element's j-th slot. Ranks of one element are correlated, which lowers the variance of the estimate; once every slot
holds less than j + 1, later steps cannot lower any and are not made. Long texts need two or three steps of the 120.

Nothing forms all pairs of a bucket. Texts with equal sets collapse first. Then each bucket names a centre, and only pairs
with a centre are verified. Rows that end in another group than the bucket's centre stay open and become centres in turn,
compared with those rows that two exact bounds leave in question: the triangle inequality of the Jaccard distance, and bit
maps of the sets, whose differing bits each prove a shingle that only one of two texts has. So no link between two groups is
lost because a third text stood at the centre, and texts that are close without a link are mostly told apart without reading them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstate.llm import common as C

#: 24 bands of 5 slots: a pair of similarity 0.85 shares no band with probability 8e-7, one of 0.8 with 8e-5.
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Words of 64 bits in the bit map of a set.
MAP = 16
#: Steps that trace the permutation back through the swaps; later ones, made for short texts only, keep it whole.
TRACED = 6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): for each text the sorted distinct hashes of its shingles of ``width`` lower-case words."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    starts, stops, bounds = C.word_spans(data, offsets)
    words = C.word_hashes(data, starts, stops)
    n = np.diff(bounds)
    sets = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), sets)
    first = bounds[row] + np.arange(sets.sum()) - np.repeat(np.cumsum(sets) - sets, sets)
    hashes = np.zeros(len(row), C.U)
    have = np.minimum(n, width)[row]
    for k in range(width):
        inside = k < have
        hashes[inside] = C.mix(hashes[inside] + words[first[inside] + k] + C.U(k + 1))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def draw(elements: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For each element a fraction in [0, 1) and a slot to swap with, at this step of its permutation."""
    r = C.mix(elements + C.U((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (r >> C.U(32)).astype(np.float64) / 2.0**32, step + ((r & C.U(0xFFFFFFFF)) * C.U(SLOTS - step) >> C.U(32)).astype(np.int64)


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The SuperMinHash sketch of every set, a row each; empty sets stay infinite."""
    sketch = np.full((len(bounds) - 1, SLOTS), np.inf)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    swaps: list[np.ndarray] = []
    table = None
    for step in range(SLOTS):
        if not len(row):
            break
        fraction, other = draw(hashes, step)
        if table is None and step >= TRACED:
            table = np.tile(np.arange(SLOTS, dtype=np.int16), (len(row), 1))
            at = np.arange(len(row))
            for j, q in enumerate(swaps):
                held = table[at, j].copy()
                table[at, j] = table[at, q]
                table[at, q] = held
        if table is None:
            slot = other
            for j in range(step - 1, -1, -1):
                slot = np.where(slot == swaps[j], j, slot)
            swaps.append(other)
        else:
            at = np.arange(len(row))
            slot = table[at, other].astype(np.int64)
            table[at, other] = table[at, step]
        np.minimum.at(sketch.reshape(-1), row * SLOTS + slot, step + fraction)
        going = (sketch.max(axis=1) > step + 1)[row]
        if not going.all():
            row, hashes = row[going], hashes[going]
            swaps = [q[going] for q in swaps]
            table = table[going] if table is not None else None
    return sketch


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of every sketch."""
    values = sketch.view(C.U).reshape(len(sketch), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=C.U), (len(sketch), BANDS)).copy()
    for k in range(ROWS):
        keys = C.mix(keys * C.U(0xD6E8FEB86659FD93) + values[:, :, k])
    return keys.view(np.int64)


def bit_maps(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MAP words for every set: an element sets the bit that its hash names."""
    bit = (hashes >> C.U(32)) % C.U(64 * MAP)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    flags = np.zeros((len(bounds) - 1, 64 * MAP), np.uint8)
    flags[row, bit.astype(np.int64)] = 1
    return np.packbits(flags, axis=1, bitorder="little").view(np.int64)


def may_link(percent: int) -> Column:
    """Whether sets of n and cn elements with maps ``bits`` and ``cbits`` can reach the similarity: each differing bit is an
    element of one set only, so the sets share at most half of n + cn less these bits."""
    differing = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("cbits")[k])) for k in range(1, MAP)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("cbits")[0])))
    return (100 + percent) * (F.col("n") + F.col("cn") - differing) >= 2 * percent * (F.col("n") + F.col("cn"))


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, digest, bands) of (id, text): set size, digest of the whole set, band keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffers(batch.column(1))
            for a, b in C.slices(offsets):
                hashes, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                keys = band_keys(sketches(hashes, bounds))
                digests = [blake2b(hashes[x:y].tobytes(), digest_size=16).digest() for x, y in zip(bounds, bounds[1:])]
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.reshape(-1)))
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(digests, pa.binary()), lists]
                yield pa.record_batch(columns, ["id", "n", "digest", "bands"])

    return docs.mapInArrow(emit, "id long, n long, digest binary, bands array<long>")


def mapped(docs: DataFrame, width: int) -> DataFrame:
    """(id, bits) of (id, text): the bit map of the text's set."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffers(batch.column(1))
            for a, b in C.slices(offsets):
                maps = bit_maps(*shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width))
                lists = pa.ListArray.from_arrays(np.arange(0, maps.size + 1, MAP, dtype=np.int32), pa.array(maps.reshape(-1)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists], ["id", "bits"])

    return docs.mapInArrow(emit, "id long, bits array<long>")


def common_shingles(width: int):
    """Arrow function: size of the intersection of the sets of two texts. Neighbouring rows share the first text."""

    @F.arrow_udf("long")
    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        left, right = left.cast(pa.large_binary()), right.cast(pa.large_binary())
        data, offsets = C.buffers(right)
        out, before, held = [], None, None
        for a, b in C.slices(offsets):
            hashes, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
            for i in range(a, b):
                text = left[i].as_py() or b""
                if text != before:
                    raw = np.frombuffer(text, np.uint8)
                    before, held = text, shingle_sets(raw, np.array([0, len(raw)]), width)[0]
                own = hashes[bounds[i - a] : bounds[i - a + 1]]
                at = np.searchsorted(held, own)
                out.append(int((held[np.minimum(at, len(held) - 1)] == own).sum()) if len(held) and len(own) else 0)
        return pa.array(out, pa.int64())

    return count


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, label: str) -> DataFrame:
    """(centre, id, j, linked) of pairs (centre, cn, id, n): exact similarity of the whole sets."""
    count = common_shingles(width)
    own = pairs.join(texts, "id")
    both = own.join(texts.select(F.col("id").alias("centre"), F.col("text").alias("centre_text")), "centre")
    counted = both.withColumn("common", count("centre_text", "text"))
    union = F.col("cn") + F.col("n") - F.col("common")
    return C.written(
        counted.select("centre", "id", (F.col("common") / union).alias("j"), (100 * F.col("common") >= percent * union).alias("linked")), label
    )


def groups(reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, component) of the texts (id, n, bands) that link with another one.

    Every bucket has a base: of its rows the hub, which meets most others over all its buckets. The text that a family was
    copied from shares bands with every copy, copies share fewer with each other; so it is the base of the family's buckets
    and the first round, in which all rows are compared with their bases, links the family. A row is open while its group
    differs from the base's. In later rounds open rows become centres, hubs first, sixteen times as many a bucket in each,
    and are compared with rows of other groups that the bounds leave in question; then groups are formed anew from all
    links. A bucket is done when no row is open, and each round ends at least one open row of it.
    """
    slack = 1 - percent / 100 + 1e-9
    rows = reps.filter("n > 0").select(F.explode("bands").alias("bucket"), "id", "n")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = C.written(rows.join(C.written(sizes, "sizes"), "bucket"), "shared")
    meets = C.written(shared.groupBy("id").agg(F.sum(F.col("size") - 1).alias("meets")), "meets")
    rows = shared.join(meets, "id").select("bucket", "id", "n", "meets")
    hub = F.struct("meets", F.bitwise_not("id").alias("down"), "n")
    bases = rows.groupBy("bucket").agg(F.max(hub).alias("c")).select("bucket", F.bitwise_not("c.down").alias("base"))
    rows = C.written(rows.join(C.written(bases, "bases"), "bucket").withColumn("open", F.lit(True)), "buckets")
    # the texts that share a bucket with another, once; later rounds keep those that are still in question
    texts = C.written(texts.join(rows.select("id").distinct(), "id", "left_semi"), "texts")
    done: DataFrame | None = None
    grouped: DataFrame | None = None
    for round_ in itertools.count():
        if round_:
            slot = F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(16**round_))
            centres = rows.filter("open").groupBy("bucket", slot.alias("slot")).agg(F.max_by(F.struct("id", "n", "bits", "of"), hub).alias("c"))
            centres = centres.select("bucket", F.col("c.id").alias("centre"), F.col("c.n").alias("cn"), F.col("c.bits").alias("cbits"), F.col("c.of").alias("cof"))
            centres = C.written(centres, f"centres-{round_}")  # so that the join is of plain shuffles, and a hot bucket can be split
            met = rows.join(centres, (rows["bucket"] == centres["bucket"]) & (F.col("of") != F.col("cof")) & may_link(percent))
        else:
            centres = rows.filter("id = base").select("bucket", F.col("id").alias("centre"), F.col("n").alias("cn"))
            centres = C.written(centres, "centres-0")
            met = rows.join(centres, "bucket").filter("id <> centre")
        # sizes alone rule out most pairs that merely share a band
        near = met.filter(f"100 * least(n, cn) >= {percent} * greatest(n, cn)")
        swap = F.col("id") < F.col("centre")
        pairs = near.select(
            F.least("id", "centre").alias("centre"), F.greatest("id", "centre").alias("id"),
            F.when(swap, F.col("n")).otherwise(F.col("cn")).alias("cn"), F.when(swap, F.col("cn")).otherwise(F.col("n")).alias("n"),
        ).distinct()
        if done is not None:
            pairs = pairs.join(done, ["centre", "id"], "left_anti")
        found = verified(pairs, texts, width, percent, f"pairs-{round_}")
        seen = found.select(F.col("centre").alias("lo"), F.col("id").alias("hi"), "j")
        done = found.select("centre", "id") if done is None else done.union(found.select("centre", "id"))
        links = found.filter("linked").select(F.col("centre").alias("a"), F.col("id").alias("b"))
        grouped = components(links if grouped is None else links.union(grouped.select(F.col("component").alias("a"), F.col("id").alias("b"))))

        if not round_:
            # distance of every row to its bucket's base; between these bounds where only the sizes are known
            apart = 1 - F.coalesce("j", F.least("n", "cn") / F.greatest("n", "cn"))
            at_most = 1 - F.coalesce("j", F.lit(0.0))
            left = (
                met.withColumns({"lo": F.least("id", "centre"), "hi": F.greatest("id", "centre")})
                .join(seen, ["lo", "hi"], "left")
                .select("bucket", "id", "n", "meets", "base", apart.alias("d"), at_most.alias("far"))
            )
        else:
            left = rows.drop("open", "of").join(centres.select("bucket", F.col("centre").alias("id")), ["bucket", "id"], "left_anti")
        left = (
            left.join(grouped, "id", "left")
            .join(grouped.select(F.col("id").alias("base"), F.col("component").alias("of_base")), "base", "left")
            .withColumn("of", F.coalesce("component", "id"))
            .withColumn("open", F.col("of") != F.coalesce("of_base", "base"))
            .drop("component", "of_base")
        )
        # by the triangle inequality, rows nearer to the base than this cannot link with an open one
        reach = left.filter("open").groupBy("bucket").agg(F.min("d").alias("reach"))
        rows = left.join(reach, "bucket").filter(f"open OR far >= reach - {slack}").drop("reach")
        rows = C.written(rows, f"open-{round_}")
        if rows.isEmpty():
            return grouped
        texts = C.written(texts.join(rows.select("id").distinct(), "id", "left_semi"), f"texts-{round_}")
        if not round_:
            rows = C.written(rows.join(mapped(texts.select("id", "text"), width), "id"), "mapped")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable. Union-find as alternating stars: every round hangs all neighbours of a node
    under the least one near it, so the depth of the trees shrinks at least by half; it ends when all trees are stars."""
    def star(e: DataFrame, larger_only: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if larger_only:  # small star: a node and its smaller neighbours go under the least of them
            side = both.filter("v < u")
            least = side.groupBy("u").agg(F.min("v").alias("m"))
            out = side.join(least, "u")
            out = out.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
        else:  # large star: larger neighbours go under the least of all
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            out = both.join(least, "u").filter("v > u").select("v", "m")
        return out.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    edges = edges.distinct()
    for k in itertools.count():
        edges = C.written(star(star(edges, False), True), f"stars-{k}")
        deep = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi")
        if deep.isEmpty() and edges.groupBy("b").count().filter("count > 1").isEmpty():  # every tree is a star
            break
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``near`` (n_shingles, component_id, kept).

    A text's set holds its distinct shingles of ``width`` lower-cased words; fewer words make one shingle. Texts are linked
    at 100 * common >= ``percent`` * union. ``component_id`` is the smallest id reachable through links, itself included;
    ``kept`` marks the rows that carry it. Texts without words, empty or null link with nothing, not even each other.
    A null id is the smallest and gives a null component. Rows that share an id are one document, with the least of their
    texts, and stand or fall together. An empty table gives an empty table. Other columns pass through unread, whatever
    their names; one named ``near`` gives way to the result.
    """
    own_key, size, joint = C.fresh(docs, "_key", "_size", "_component")
    keyed = docs.withColumn(own_key, C.key(id_col))
    brief = docs.select(C.key(id_col).alias("id"), F.col(text_col).alias("text"))
    if brief.groupBy("id").count().filter("count > 1").limit(1).count():
        brief = brief.groupBy("id").agg(F.min("text").alias("text"))
    sketch = C.written(sketched(brief, width), "sketch")
    reps = sketch.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep"))
    own = sketch.join(reps, "digest").filter("id = rep").select("id", "n", "bands")
    found = groups(own, brief, width, percent).withColumnRenamed("id", "rep")
    rep = sketch.join(reps, "digest", "left").select("id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    group = rep.join(found, "rep", "left").select(F.col("id").alias(own_key), F.col("n").alias(size), F.coalesce("component", "rep", "id").alias(joint))
    near = F.struct(
        F.col(size).alias("n_shingles"),
        F.when(F.col(joint) != C.NO_ID, F.col(joint)).alias("component_id"),
        (F.col(joint) == F.col(own_key)).alias("kept"),
    )
    return keyed.join(group, own_key).select(*[c for c in docs.columns if c.lower() != "near"], near.alias("near"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept; shingles of 3 words, similarity 0.85."""
    near = near_duplicates(docs.select("doc_id", "text"), width=3, percent=85)
    return near.select("doc_id", "near.n_shingles", "near.component_id", "near.kept")
