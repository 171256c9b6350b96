"""Near-duplicates by SuperMinHash signatures, banding, full verification and components.

A document's set is its distinct shingles of five words, as 64-bit hashes, or its
whole word sequence as one if it has fewer. Two documents are linked if their sets'
Jaccard similarity reaches `percent`; a component is what links join.

1. One pass makes each document's set, from it a 128-bit name that doesn't depend on
   order and a SuperMinHash signature: in round j every shingle gives one component,
   chosen by its own random permutation, the value j plus a random fraction, and the
   rounds end once no component can get less. Bands of ROWS components are its keys.
2. Documents of one set are one class from here on, by its least doc_id.
3. Classes that share a band key are a bucket. Buckets of the same classes count once.
   At 85 % a linked pair shares none of the keys with a chance of 7e-9.
4. Full sets meet in blocks of bounded size; the exact intersections are a product of
   bounded matrices, and only a spanning forest of the links leaves the task, so
   neither all pairs of a group nor all of its links are ever rows. First come heads,
   a class for each component of a bucket, a large bucket in parts that share a few
   pivots: rows grow with classes, and a group of copies becomes one component.
5. Components by repeated contraction of the links to least neighbours, as tables;
   after the bands of each of STEPS, so that later bands have few heads.
6. At last, in buckets that still hold several components, every pair of two of them
   meets. A bucket's largest component costs a row a class for each part of the rest.

Defined results: null and empty texts have no shingles, are linked with nothing and
are their own components; rows of equal doc_id are one document; rows without doc_id
link nothing, have a null component_id and are kept; repeated rows share their
component; no rows give no rows; whole texts are read; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from concord.llm._common import SENT_ROWS, arrow_pass, batch_of, columns, few, forget, slices, written

WORDS, PERCENT = 5, 85
BANDS, ROWS = 32, 5
#: Bands before which components are brought up to date.
STEPS = (3,)
#: Bounds of a block's side: classes, and shingles of all of them together.
MOST_CLASSES, MOST_SHINGLES, PIVOTS = 500, 600_000, 16
#: Characters of the texts that a worker takes at once.
MOST_CHARS = 4_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of all texts in a row, and the size of each."""
    import xxhash

    n = len(texts)
    # a copy: of a slice of an array, Arrow's lower-casing returns other bytes
    fresh = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(fresh))
    flat = split.flatten().cast(pa.large_string())
    doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    kept = np.flatnonzero(pc.binary_length(flat).to_numpy())
    coded = flat.take(pa.array(kept)).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    doc = doc[kept]
    word = each[coded.indices.to_numpy()] if len(kept) else np.empty(0, np.uint64)
    counts = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        if len(word) >= words:
            last = len(word) - words + 1
            full = np.full(last, np.uint64(words) * GOLDEN, np.uint64)
            for k in range(words):
                full = mix(full + word[k : last + k] + GOLDEN)
            inside = doc[:last] == doc[words - 1 :]
            hashes, owner = full[inside], doc[:last][inside]
        else:
            hashes, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < words))
        if len(short):
            whole = counts[short].astype(np.uint64) * GOLDEN
            for k in range(words - 1):
                there = counts[short] > k
                at = np.where(there, ends[short] - counts[short] + k, 0)
                whole = np.where(there, mix(whole + word[at] + GOLDEN), whole)
            hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[b:e].sort()
    if len(hashes):
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
        hashes, owner = hashes[new], owner[new]
    return hashes, np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)


def superminhash(items: np.ndarray, sizes: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """Signatures (a row each) of sets given in a row; component values compare as 16 bits of round and 48 of fraction."""
    out = np.full((len(sizes), m), TOP, np.uint64)
    flat = out.ravel()
    row = np.repeat(np.arange(len(sizes)), sizes)
    state, places, step = mix(items + np.uint64(seed) * GOLDEN), None, 0
    while len(row) and step < m:
        with np.errstate(over="ignore"):
            state = state + GOLDEN
            drawn = mix(state)
        other = step + ((mix(drawn ^ GOLDEN) >> np.uint64(32)) * np.uint64(m - step) >> np.uint64(32)).astype(np.int64)
        if places is None and step == 0:
            chosen = other
        else:
            lines = np.arange(len(row))
            chosen = places[lines, other].astype(np.int64)
            places[lines, other] = places[lines, step]
        np.minimum.at(flat, row * m + chosen, (np.uint64(step) << np.uint64(48)) | (drawn >> np.uint64(16)))
        step += 1
        open_rows = np.zeros(len(sizes), bool)
        some = np.unique(row)
        open_rows[some] = out[some].max(axis=1) >= np.uint64(step) << np.uint64(48)
        going = open_rows[row]
        if places is None:
            # only sets with few shingles for m components come here, so this table is small
            row, state, first = row[going], state[going], chosen[going]
            places = np.tile(np.arange(m, dtype=np.uint16), (len(row), 1))
            places[np.arange(len(row)), first] = 0
        elif np.count_nonzero(going) <= 0.7 * len(going) or not going.any():
            row, state, places = row[going], state[going], places[going]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(signatures), 1))
    parts = signatures.reshape(len(signatures), bands, rows)
    for k in range(rows):
        with np.errstate(over="ignore"):
            keys = mix(keys + parts[:, :, k] + GOLDEN)
    return keys


def sketches(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, chunk: int = 32_768, most: int = MOST_CHARS) -> DataFrame:
    """doc_id, n, set_a, set_b and keys of each document; no keys where it has no shingles."""

    def make():
        def step(batch):
            out = []
            texts = batch.column(1)
            for b, e in slices(texts.to_pylist(), most):
                items, sizes = shingle_sets(texts.slice(b, e - b), words)
                starts = np.cumsum(sizes) - sizes
                full = np.flatnonzero(sizes)
                with np.errstate(over="ignore"):
                    names = [np.zeros(e - b, np.uint64) for _ in range(2)]
                    for k, name in enumerate(names):
                        if len(full):
                            name[full] = np.add.reduceat(mix(items * GOLDEN + np.uint64(k + 1)), starts[full])
                keys = np.zeros((e - b, bands), np.uint64)
                order = full[np.argsort(sizes[full], kind="stable")]
                at = 0
                while at < len(order):
                    upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[order[at:]]), chunk, "right")) + at)
                    own = order[at:upto]
                    where = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in own])
                    keys[own] = band_keys(superminhash(items[where], sizes[own], bands * rows), bands, rows)
                    at = upto
                has = np.where(sizes > 0, bands, 0)
                out.append(
                    batch_of(
                        doc_id=batch.column(0).slice(b, e - b), n=sizes.astype(np.int64), set_a=names[0].view(np.int64), set_b=names[1].view(np.int64),
                        keys=pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has)].astype(np.int32)), pa.array(keys[sizes > 0].ravel().view(np.int64))),
                    )
                )
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return step

    rows_in = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_pass(rows_in, make, "doc_id long, n long, set_a long, set_b long, keys array<long>")


def full_sets(docs: DataFrame, words: int = WORDS, most: int = MOST_CHARS) -> DataFrame:
    """rep (doc_id), set_a and the whole set of each document."""

    def make():
        def step(batch):
            out = []
            texts = batch.column(1)
            for b, e in slices(texts.to_pylist(), most):
                items, sizes = shingle_sets(texts.slice(b, e - b), words)
                ends = np.cumsum(sizes)
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                with np.errstate(over="ignore"):
                    name = np.add.reduceat(mix(items * GOLDEN + np.uint64(1)), (ends - sizes)[full])
                data = items.tobytes()
                out.append(
                    batch_of(
                        rep=batch.column(0).slice(b, e - b).take(pa.array(full)), set_a=name.view(np.int64),
                        items=pa.array([data[8 * (ends[i] - sizes[i]) : 8 * ends[i]] for i in full], pa.binary()),
                    )
                )
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

        return step

    return arrow_pass(docs.select("doc_id", "text"), make, "rep long, set_a long, items binary")


def links(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT, width: int = 4096) -> np.ndarray:
    """Which of the sets (each sorted) are linked, as a matrix; those of sides 0 and 1 only across."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    items, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    often = np.bincount(at, minlength=len(items)) > 1
    number = np.cumsum(often) - 1
    row, at = row[often[at]], number[at[often[at]]]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total = int(at[-1]) + 1 if len(at) else 0
    for b in range(0, total, width):
        lo, hi = np.searchsorted(at, [b, b + width])
        part = np.zeros((n, min(width, total - b)), np.float32)
        part[row[lo:hi], at[lo:hi] - b] = 1
        shared += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared
    linked = 100 * shared.astype(np.float64) >= percent * union
    np.fill_diagonal(linked, False)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    return linked


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for every member of a component of several."""
    out, left = [], np.ones(len(linked), bool)
    for root in np.flatnonzero(linked.any(axis=1)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            new = linked[todo].any(axis=0) & left
            todo = np.flatnonzero(new).tolist()
            left[todo] = False
            out.extend((root, int(x)) for x in todo)
    return out


def verified(blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (x, y) of reps by full sets; blocks has block, side, rep and items, a block's rows one after another."""

    def make():
        state = {"block": None, "rows": []}

        def close(out):
            rows = state["rows"]
            if len(rows) > 1:
                rows.sort()
                sets = [np.frombuffer(r[2], np.uint64) for r in rows]
                for a, b in forest(links(sets, np.array([r[1] for r in rows]), percent)):
                    out.append((rows[a][0], rows[b][0]))
            state["rows"] = []

        def step(batch):
            out: list = []
            if batch is None:
                close(out)
            else:
                for block, side, rep, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if block != state["block"]:
                        close(out)
                        state["block"] = block
                    if not state["rows"] or state["rows"][-1][0] != rep:  # a pivot stands in its part twice
                        state["rows"].append((rep, side, items))
            if not out:
                return None
            return batch_of(x=pa.array([a for a, _ in out], pa.int64()), y=pa.array([b for _, b in out], pa.int64()))

        return step

    ordered = blocks.select("block", "side", "rep", "items").repartition("block").sortWithinPartitions("block", "rep")
    return arrow_pass(ordered, make, "x long, y long", finish=True).filter("x <> y")


def parts_of(classes: Column, shingles: Column, most_classes: int, most_shingles: int) -> Column:
    return F.greatest(F.ceil(classes / most_classes), F.ceil(shingles / most_shingles), F.lit(1)).cast("int")


def members_name(*more: str) -> list[Column]:
    """Two sums that tell a bucket's members from another's, so that buckets of the same members count once."""
    return [F.sum(F.xxhash64(*c, *more) % (1 << 40)).alias(n) for n, c in (("names", ("rep", "set_a")), ("more", ("set_a", "rep")))]


def head_blocks(members: DataFrame, most_classes: int, most_shingles: int, pivots: int = PIVOTS) -> DataFrame:
    """block, side, rep and set_a: the least member of each component of a bucket (members have key, rep, set_a, n, component).

    A large bucket goes in parts, each with the bucket's pivots, so rows grow with
    members, whatever a bucket's size; pivots that link join the parts.
    """
    heads = members.groupBy("key", "component").agg(F.min(F.struct("rep", "set_a", "n")).alias("h")).select("key", "h.*")
    sums = heads.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"), *members_name()).filter("classes > 1")
    once = sums.groupBy("classes", "shingles", "names", "more").agg(F.min("key").alias("key"))
    parts = parts_of(F.col("classes"), F.col("shingles"), most_classes, most_shingles)
    dealt = heads.join(once.select("key", parts.alias("parts")), "key").withColumn("own", F.pmod(F.xxhash64("rep", "key"), "parts").cast("int"))
    slots = dealt.filter("parts > 1").groupBy("key", "parts", F.pmod(F.xxhash64("rep"), F.lit(pivots)).alias("slot")).agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep", "set_a")).alias("p"))
    spread = slots.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"), "p.rep", "p.set_a")
    rows = dealt.select("key", "own", "rep", "set_a").unionAll(spread)
    return rows.select(F.xxhash64("key", "own").alias("block"), F.lit(0).alias("side"), "rep", "set_a")


def rest_blocks(members: DataFrame, most_classes: int, most_shingles: int) -> DataFrame:
    """block, side, rep and set_a: whatever heads left out, so that every pair of a bucket that no component holds meets in a block.

    A bucket's most frequent component is dealt apart: its own parts needn't meet, so
    a group of copies costs a row a member for each part of the others.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    told = counts.groupBy("key").agg(F.max_by(F.struct("component", "c", "n"), F.struct("c", "component")).alias("m"), F.sum("c").alias("classes"), F.sum("n").alias("shingles"), F.count("*").alias("kinds"))
    whole = (F.col("classes") <= most_classes) & (F.col("shingles") <= most_shingles)
    # where each component has one member and one block held them all, nothing is left
    told = told.filter(F.col("kinds") > 1).filter((F.col("m.c") > 1) | ~whole)
    p = parts_of(F.col("m.c"), F.col("m.n"), most_classes, most_shingles)
    q = parts_of(F.col("classes") - F.col("m.c"), F.col("shingles") - F.col("m.n"), most_classes, most_shingles)
    told = told.select("key", F.col("m.component").alias("main"), F.when(whole, 0).otherwise(p).alias("p"), F.when(whole, 1).otherwise(q).alias("q"))
    dealt = members.join(told, "key").withColumn("rest", (F.col("component") != F.col("main")) | (F.col("p") == 0))
    names = dealt.groupBy("key", "p", "q").agg(*members_name("rest")).groupBy("p", "q", "names", "more").agg(F.min("key").alias("key")).select("key")
    slot = F.xxhash64("rep", "key")
    dealt = dealt.join(names, "key").withColumn("own", F.when(F.col("rest"), F.col("p") + F.pmod(slot, F.col("q"))).otherwise(F.pmod(slot, F.greatest("p", F.lit(1)))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(F.col("rest"), 0).otherwise(F.col("p")).cast("int"), F.col("p") + F.col("q") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.select(F.xxhash64("key", low, high).alias("block"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "set_a")


def links_of(texts: DataFrame, blocks: DataFrame, words: int, percent: int, most_chars: int, repeated: bool, sent: int) -> DataFrame:
    """The links in the blocks, by the full sets of their members."""
    blocks = written(blocks, "blocks")
    wanted = written(blocks.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = full_sets(texts.join(few(wanted, sent), "doc_id", "left_semi"), words, most_chars)
    if repeated:
        sets = sets.dropDuplicates(["rep", "set_a"])
    found = written(verified(sets.join(few(blocks, sent), ["rep", "set_a"]), percent), "links")
    forget(blocks, wanted)
    return found


def components(edges: DataFrame, sent: int = SENT_ROWS) -> DataFrame:
    """node and component (its least node) for every node of the edges (x, y)."""
    edges = written(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x <> y").distinct(), "edges")
    labels = written(edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        near = edges.union(edges.select("y", "x")).groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("up"))
        near = written(near, "near")
        tops = few(near, sent)
        to = written(near.join(tops.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("to")), "to")
        sides = few(to, sent)
        now = written(labels.join(sides.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        left = edges.join(sides.select(F.col("node").alias("x"), F.col("to").alias("a")), "x").join(sides.select(F.col("node").alias("y"), F.col("to").alias("b")), "y")
        left = written(left.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).filter("x <> y").distinct(), "edges")
        forget(near, to, labels, edges)
        labels, edges = now, left
    forget(edges)
    return labels


def group(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, steps: tuple[int, ...] = STEPS, most_classes: int = MOST_CLASSES, most_shingles: int = MOST_SHINGLES,
    most_chars: int = MOST_CHARS, sent: int = SENT_ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    texts = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    made = written(sketches(texts, words, bands, rows, most=most_chars), "sketches")
    own = made.filter("n > 0 and doc_id is not null")
    classes = written(own.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")), "classes")
    repeated = not own.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    labels, edges = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0), None
    bounds = [0, *[s for s in steps if s < bands], bands]
    keyed = classes.select("rep", "set_a", "n", F.posexplode("keys").alias("band", "key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "shared")
    members = written(keyed.join(few(shared, sent), "key", "left_semi"), "members")
    forget(shared)
    for b, e, deal in [*[(x, y, head_blocks) for x, y in zip(bounds, bounds[1:], strict=False)], (0, bands, rest_blocks)]:
        now = members.filter(F.col("band").between(b, e - 1)).join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).drop("band")
        found = links_of(texts, deal(now, most_classes, most_shingles), words, percent, most_chars, repeated, sent)
        all_links = found if edges is None else written(edges.unionAll(found), "links")
        if edges is not None:
            forget(found, edges, labels)
        edges, labels = all_links, components(all_links)
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n", "set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = made.select("doc_id", "n", "set_a", "set_b").join(named, ["n", "set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - {WORDS - 1}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS s FROM words
), flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), edges AS (
  SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * shared >= {PERCENT} * (len(p.s) + len(q.s) - shared)
), both_ways AS (SELECT x, y FROM edges UNION ALL SELECT y, x FROM edges),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT b.y, r.seen FROM reach r JOIN both_ways b ON b.x = r.node WHERE b.y > r.seen
), least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON node = doc_id
"""
