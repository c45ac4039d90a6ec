"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document is the set of its five-word shingles. SuperMinHash gives each set a signature: every
element walks through its own random permutation of the signature's places, and a place keeps the
least value of (step + random fraction) that reached it, so the ranks of one element are correlated
and the estimate has a lower variance than with independent hashes. The walk of a set stops once no
later step can lower any place.

Equal sets become one class first. Classes that agree in a band of their signatures are candidates:
every member is compared with a hub of its buckets, confirmed pairs are merged, and buckets that
still hold several components get further hubs, and at last all pairs across components. So no
group of similar documents is expanded into all its pairs, and yet no candidate is left out.

Defined cases: texts without words (null, empty) have no shingles and link with nothing; fewer than
``width`` words count as one shingle, their whole sequence; rows with equal ids are one node; rows
without an id link with nothing, their component is null and they are kept; other columns are
ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstat.llm.components import components
from glyphstat.llm.storage import cut
from glyphstat.llm.words import Words, as_bytes, chunks, mix, piece_hashes

SHINGLE_WORDS = 5

# 24 bands of 3 places: two sets of similarity 0.8 share no band with probability 3e-8.
BANDS, ROWS = 24, 3
PLACES = BANDS * ROWS

# Rounds with one hub per bucket before what remains is compared by how it differs from hubs.
HUB_ROUNDS = 2


def shingle_sets(texts: list, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ordered by text and hash, and the bounds of each text."""
    w = Words(texts)
    words = w.hashes(lower=True)
    windows, whole = w.windows(words, width)
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    short_hash = piece_hashes(words, w.first[short], w.first[short + 1])
    hashes = np.concatenate([windows[whole], short_hash])
    doc = np.concatenate([w.doc[whole], short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(w.n + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures, one row of ``places`` values per set; empty sets keep infinity."""
    n = len(bounds) - 1
    values = np.full(n * places, np.inf)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    permutation = None
    for step in range(places):
        if not len(hashes):
            break
        bits = mix(hashes ^ mix(np.full(1, step + 1, np.uint64)))
        other = step + (mix(bits) % np.uint64(places - step)).astype(np.int64)
        if permutation is None:
            place = other
        else:
            rows = np.arange(len(hashes))
            place = permutation[rows, other].astype(np.int64)
            permutation[rows, other] = permutation[rows, step]
        np.minimum.at(values, owner * places + place, step + (bits >> np.uint64(11)) * 2.0**-53)
        going = (values.reshape(n, places).max(axis=1) >= step + 1)[owner]
        if permutation is None:
            # The first swap of every element that goes on.
            permutation = np.tile(np.arange(places, dtype=np.uint8), (int(going.sum()), 1))
            permutation[np.arange(len(permutation)), other[going]] = 0
        else:
            permutation = permutation[going]
        hashes, owner = hashes[going], owner[going]
    return values.reshape(n, places)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band."""
    bits = values.view(np.uint64).reshape(len(values), BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), bits.shape[:2])
    for row in range(ROWS):
        keys = mix(keys ^ bits[:, :, row])
    return keys


_CLASS = ["n_shingles", "set_a", "set_b"]


def _digests(hashes: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Two 64-bit digests of each set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)))])
        out.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, n_shingles, set_a, set_b, bands)``: hash of the text, size, 128-bit digest and band keys of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, bounds = shingle_sets(as_bytes(batch.column("text")))
            keys = band_keys(signatures(hashes, bounds)).view(np.int64)
            bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("fp"), pa.array(np.diff(bounds)), *_digests(hashes, bounds), bands],
                names=["doc_id", "fp", *_CLASS, "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text").mapInArrow(
        run, "doc_id long, fp long, n_shingles long, set_a long, set_b long, bands array<long>"
    )


def sets_of(texts: DataFrame) -> DataFrame:
    """``(node, shingles)``: the sorted shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, bounds = shingle_sets(as_bytes(batch.column("text")))
            sets = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets have at least ``percent`` similarity."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v"))

    common = F.size(F.array_intersect("set_u", "set_v"))
    both = F.size("set_u") + F.size("set_v") - common
    return pairs.join(left, "u").join(right, "v").filter(common * 100 >= both * percent).select("u", "v")


def _forest(edges: DataFrame) -> DataFrame:
    """Union-find inside each task: edges (node, root) that connect the same nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], names=["u", "v"]
            )

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
            if len(parent) > 500_000:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return edges.mapInArrow(run, "u long, v long").filter("u <> v")


def _length_ok(percent: int, a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _hubs(open_: DataFrame, company: DataFrame) -> DataFrame:
    """``(key, hub)``: the node of each bucket with the most company in all its buckets."""
    return open_.join(company, "node").groupBy("key").agg(
        F.max_by(F.struct("node", "n", "component"), F.struct("company", -F.col("node"))).alias("hub")
    )


def _renamed(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after ``links(u, v)``: u takes the least label of the nodes it is linked to, if that is less than its own.

    Nodes of one label are connected; that connected nodes have one label is left to the components at the end.
    """
    least = links.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("least"))
    named = label.join(least, F.col("node") == F.col("u"), "left")
    return cut(named.select("node", F.least("component", F.coalesce("least", "component")).alias("component")))


def differences(open_: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(hub, node, n, component, delta, d, w, linked)``: how each node of a bucket differs from the bucket's hub.

    ``delta`` is the symmetric difference of the sets and ``d`` its size; ``linked`` whether they are similar enough. Two sets x and y of a
    bucket are similar enough if and only if their differences have (w(x) + w(y)) / 2 shingles in common at least,
    with w = d - c n and c = (100 - percent) / (100 + percent).
    """
    rows = open_.join(hubs, "key").filter("node <> hub.node").select("node", "n", "component", "hub").distinct()
    mine = sets.select("node", "shingles")
    theirs = sets.select(F.col("node").alias("_hub"), F.col("shingles").alias("_hub_set"))
    both = rows.join(mine, "node").join(theirs, F.col("hub.node") == F.col("_hub"))
    delta = F.concat(F.array_except("shingles", "_hub_set"), F.array_except("_hub_set", "shingles"))
    found = both.select(F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.component").alias("hub_component"), "node", "n", "component", delta.alias("delta"))
    share = (100 - percent) / (100 + percent)
    d = F.size("delta")
    whole = F.col("n") + F.col("hub_n")
    # common = (whole - d) / 2 and union = (whole + d) / 2.
    linked = (whole - d) * 100 >= (whole + d) * percent
    return found.dropDuplicates(["hub", "node"]).select(
        "hub", "hub_component", "node", "n", "component", "delta", d.alias("d"), (d - F.col("n") * share).alias("w"), linked.alias("linked")
    )


def _candidates(deltas: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)`` of one hub in different components that can be similar enough.

    A node that is linked to the hub is in the hub's component, so one of a pair at least is not, and its difference
    is so large that similar sets share part of their differences. The shingles of all differences of a hub are put in order from
    rare to frequent; sets that share ``alpha`` of them share one among the first ``d - alpha + 1`` of each, and the first
    that they share leaves enough behind it in both. Copies that were altered independently share no rare
    ones, so most pairs never meet, however many copies a hub has.
    """
    now = deltas.drop("component").join(labels, "node")
    bounds = now.groupBy("hub").agg(F.min("w").alias("least"), F.min(F.when(~F.col("linked"), F.col("w"))).alias("least_apart"))
    now = now.join(bounds.filter("least_apart IS NOT NULL"), "hub")

    def prefix(least: str):
        alpha = F.greatest(F.ceil((F.col("w") + F.col(least)) / 2 - 1e-9), F.lit(1))
        return F.col("d") - alpha + 1

    rows = now.select(
        "hub", "node", "n", "component", "d", "w", "linked", prefix("least").alias("long"), prefix("least_apart").alias("short"),
        F.explode("delta").alias("token"),
    )
    often = F.count(F.lit(1)).over(Window.partitionBy("hub", "token"))
    place = F.row_number().over(Window.partitionBy("hub", "node").orderBy("often", "token"))
    rows = rows.withColumn("often", often).withColumn("place", place).filter(F.col("place") <= F.when(F.col("linked"), F.col("short")).otherwise(F.greatest("long", "short")))
    rows = cut(rows.filter("often > 1").drop("often"))
    apart = rows.filter("NOT linked").select("hub", "token", *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "component", "d", "w", "long", "short", "place")))
    other = rows.filter("place <= short").select("hub", "token", *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "component", "d", "w", "linked", "place")))
    rest = 1 + F.least(F.col("a_d") - F.col("a_place"), F.col("b_d") - F.col("b_place"))
    keep = (
        (F.col("a_component") != F.col("b_component")) & (F.col("b_linked") | (F.col("a_node") < F.col("b_node")))
        & (F.col("a_place") <= F.when(F.col("b_linked"), F.col("a_long")).otherwise(F.col("a_short")))
        & (rest >= (F.col("a_w") + F.col("b_w")) / 2 - 1e-9) & _length_ok(percent, "a_n", "b_n")
    )
    met = apart.join(other, ["hub", "token"]).filter(keep)
    return met.select(F.greatest("a_node", "b_node").alias("u"), F.least("a_node", "b_node").alias("v")).distinct()


def similar_classes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components ``(node, component)`` among ``members(key, node, n)``, the buckets' entries."""
    nodes = members.select("node").distinct()
    label = nodes.withColumn("component", F.col("node"))
    links = used = None
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    company = cut(members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("company")))

    def still_open() -> DataFrame:
        entries = members.join(label, "node")
        spread = entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        return cut(entries.join(spread.filter("low < high").select("key"), "key"))

    def add(found: DataFrame) -> DataFrame:
        nonlocal links
        links = found if links is None else links.union(found)
        return found

    for step in range(HUB_ROUNDS):
        open_ = still_open()
        # The hub of a bucket is the node with the most company in all its buckets that has not been
        # one: of a text and its altered copies that is the text. A node is compared with the hub
        # that it shares most buckets with; the others have their turn later.
        hubs = _hubs(open_ if used is None else open_.join(used, "node", "left_anti"), company)
        chosen = hubs.select("hub.node").distinct()
        used = cut(chosen if used is None else chosen.union(used))
        shared = (
            open_.join(hubs, "key").filter("component <> hub.component")
            .groupBy("node", "n", F.col("hub.node").alias("other"), F.col("hub.n").alias("n_other"))
            .agg(F.count("*").alias("shared"))
        )
        best = F.max_by(F.struct("other", "n_other"), F.struct("shared", -F.col("other"))).alias("best")
        pairs = shared.filter(_length_ok(percent, "n", "n_other")).groupBy("node", "n").agg(best).select(
            F.col("node").alias("u"), F.col("best.other").alias("v")
        )
        label = _renamed(label, add(cut(confirmed(pairs, sets, percent))))
    open_ = still_open()
    # What is left: every node against the hub of each of its buckets, then nodes that differ from a hub alike.
    deltas = cut(differences(open_, _hubs(open_, company), sets, percent))
    near_hub = deltas.filter("linked AND component <> hub_component").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    label = _renamed(label, add(near_hub))
    add(confirmed(_candidates(deltas, label, percent), sets, percent))
    found = nodes.join(components(_forest(links)), "node", "left")
    return cut(found.select("node", F.coalesce("component", "node").alias("component")))


def near_duplicates(docs: DataFrame, percent: int = 80, groups: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    ``component_id`` is the least id that can be reached over pairs of at least ``percent``
    similarity; the row whose id that is stays. With ``groups`` there is also ``fp``, a hash of the row's text, and ``group_id``, which
    tells groups apart whose least ids are equal, and is null for rows that are in no group.
    """
    prints = cut(fingerprints(docs))
    classes = prints.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*_CLASS).agg(
        F.min(F.struct("doc_id", "fp")).alias("first"), F.first("bands").alias("bands")
    )
    # The checkpoint fixes the rows of each partition, and so the numbers.
    classes = cut(classes).withColumn("node", F.monotonically_increasing_id())
    entries = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = cut(entries.join(shared.select("key"), "key").select("key", "node", "n"))
    # One text of each class that shares a bucket: the first one. Equal rows give equal sets.
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("first.*", "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text").join(wanted, ["doc_id", "fp"])
    sets = sets_of(texts.select("node", "text"))
    labels = similar_classes(members, cut(sets), percent)
    named = classes.join(labels, "node", "left").select(*_CLASS, F.col("first.doc_id").alias("first_id"), F.coalesce("component", "node").alias("group_id"))
    named = cut(named)
    least = named.groupBy("group_id").agg(F.min("first_id").alias("component_id"))
    out = prints.select("doc_id", "fp", *_CLASS).join(named.join(least, "group_id").drop("first_id"), _CLASS, "left")
    # Rows without shingles stand alone, and rows without an id have none.
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    group = F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("group_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *(["fp", group] if groups else []),
    )
