"""Jaccard self-join of word-shingle sets by token-combination prefixes.

All texts order their shingles alike: rare ones by hash, then frequent ones by hash. A set of
n shingles with similarity s >= 0.75 to another misses at most n // 4 of its own, so a prefix
that cannot lose all its signatures by n // 4 misses is enough to index. Rare shingles are
signatures by themselves. Frequent ones are dealt into classes by hash and are indexed as
pairs within a class; each class costs the prefix one more shingle, as one left over makes no
pair. Two sets that link share a signature, whichever classes their common shingles are in.

Candidates of a signature are compared with one of them, then with some, then with more, and
only while the signature still holds more than one component: a group of copies makes one pair
a member. Copies that differ too much to link share most signatures too. Each set has a sketch,
the parities of its shingles dealt out to BITS places: two sets differ in as many shingles, at
least, as their sketches in places, so pairs whose sketches differ in more than links allow
are left out without their sets being read, and no link is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.components import components
from driftlens.llm.textkernel import U64, lists, mix, shingle_sets, steps
from driftlens.llm.workspace import Workspace, shuffle_cleanup

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A shingle in at least this many prefixes is frequent ...
FREQUENT = 8
#: ... unless more than so many are: then the bound doubles until the list, which is broadcast, fits.
MOST_FREQUENT = 1 << 18
#: Rounds of comparing with one member of each signature; after them the number of members
#: that the others are compared with grows by LEADS_GROW from round to round.
STAR_ROUNDS = 2
LEADS_GROW = 16
#: Places of a sketch, in words of 64. Sets of more than about 1.75 * BITS shingles are hardly told apart by it.
BITS = 1024
SKETCH = [f"s{i}" for i in range(BITS // 64)]


def misses(n: np.ndarray | int) -> np.ndarray | int:
    """Most shingles that a set of n misses of one that it links with: n - ceil(0.75 * n)."""
    return n // 4


def node_ids(values: np.ndarray, offs: np.ndarray, draw: int = 0) -> np.ndarray:
    """64 bits of each set's content; two draws make the id under which equal sets are one node."""
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(values + U64(draw * 0xA24BAED4963EE407 & (1 << 64) - 1)), dtype=U64)))
    size = np.diff(offs).astype(U64)
    return mix((total[offs[1:]] - total[offs[:-1]]) ^ mix(size + U64(draw))).view(np.int64)


def band(n: int) -> int:
    return int(np.log(n) / np.log(4 / 3) + 1e-9)


def classes_of(b: int) -> int:
    """Classes of frequent shingles for sets from band b on: about one for eight shingles."""
    least = int(np.ceil((4 / 3) ** b - 1e-9))
    return max(1, min(least - least // 4 - 1, least // 8))


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of one sorted set, given which of its shingles are frequent."""
    n = len(tokens)
    need = misses(n) + 1
    light = tokens[~frequent]
    if len(light) >= need:
        return mix(light[:need])
    out = [mix(light)]
    need -= len(light)
    heavy = tokens[frequent]
    own = band(n)
    for b in {own, max(own - 1, 0)}:
        m = classes_of(b)
        kind = (mix(heavy ^ U64(b + 1)) % U64(m)).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        first = np.ones(len(heavy), bool)
        sorted_kind = kind[order]
        again = np.zeros(len(heavy), bool)
        again[order[1:]] = sorted_kind[1:] == sorted_kind[:-1]
        first = ~again
        cut = int(np.searchsorted(np.cumsum(~first), need)) + 1
        for c in np.unique(kind[:cut]):
            x = heavy[:cut][kind[:cut] == c]
            i, j = np.triu_indices(len(x), 1)
            out.append(mix(mix(x[i] + U64(b + 1)) ^ x[j]))
    return np.unique(np.concatenate(out))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, buf, offs in steps(batch, "text"):
        values, at = shingle_sets(buf, offs, WIDTH)
        yield a, b, values, at


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's node (128 bits) and set size."""
    for batch in batches:
        for a, b, values, at in _sets(batch):
            arrays = [batch.column(0).slice(a, b - a), *(pa.array(node_ids(values, at, d)) for d in (0, 1)), pa.array(np.diff(at).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "node", "node2", "n"])


def _first_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of every prefix in the order of hashes alone, packed by part."""
    for batch in batches:
        for _, _, values, at in _sets(batch):
            n = np.diff(at)
            take = np.minimum(misses(n) + 1, n)
            pos = np.arange(len(values)) - np.repeat(at[:-1], n)
            tokens = values[pos < np.repeat(take, n)]
            if len(tokens):
                token, count = np.unique(tokens, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int32))], names=["token", "c"])


def frequent_shingles(texts: DataFrame, space: Workspace) -> np.ndarray:
    """Sorted hashes of the frequent shingles, at most MOST_FREQUENT; counts are over all documents.

    What comes to the driver is a histogram of powers of two and then that bounded list.
    """
    counts = texts.mapInArrow(_first_prefixes, "token bigint, c int").groupBy("token").agg(F.sum("c").alias("n")).where(F.col("n") >= FREQUENT)
    counts = space.keep(counts, "frequent")
    by_power = {int(r["p"]): int(r["k"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("k")).collect()}
    total, least = 0, None
    for p in sorted(by_power, reverse=True):
        total += by_power[p]
        if total > MOST_FREQUENT:
            break
        least = p
    if least is None:
        return np.zeros(0, U64)
    tokens = counts.where(F.col("n") >= (1 << least)).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(tokens.view(U64))


def signature_rows(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(sig, id, node, n) of every document's set."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b, values, at in _sets(batch):
                if not len(values):
                    continue
                if len(known):
                    k = np.minimum(np.searchsorted(known, values), len(known) - 1)
                    often = known[k] == values
                else:
                    often = np.zeros(len(values), bool)
                ids, n, node = batch.column(0).slice(a, b - a), np.diff(at), node_ids(values, at)
                order = pc.sort_indices(pa.table({"node": node, "id": ids}), [("node", "ascending"), ("id", "ascending")]).to_numpy()
                once = order[np.concatenate(([True], np.diff(node[order]) != 0))]  # of equal sets, the smallest id stands for all
                once = once[n[once] > 1]  # a set of one shingle links with its equals only
                sigs = [signatures(values[at[i] : at[i + 1]], often[at[i] : at[i + 1]]) for i in once]
                size = np.array([len(s) for s in sigs], np.int64)
                if size.sum():
                    arrays = [pa.array(np.concatenate(sigs).view(np.int64)), ids.take(pa.array(np.repeat(once, size))), pa.array(np.repeat(node[once], size)), pa.array(np.repeat(n[once], size).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["sig", "id", "node", "n"])

    return texts.mapInArrow(run, f"sig bigint, id {id_type}, node bigint, n int")


def members(texts: DataFrame, frequent: np.ndarray, firsts: DataFrame, space: Workspace) -> DataFrame:
    """(sig, doc, n, held) of the signatures that more than one node has, ``held`` by so many rows; a node's smallest id stands for it."""
    shared = signature_rows(texts, frequent).groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("held")).where(F.col("lo") != F.col("hi")).select("sig", "held")
    shared = space.keep(shared, "shared")
    rows = space.keep(signature_rows(texts, frequent).select("sig", F.col("id").alias("doc"), "n").join(shared, "sig"), "by-sig")
    out = space.keep(rows.join(firsts.select(F.col("id").alias("doc")).distinct(), "doc", "left_semi"), "members")
    for label in ("shared", "by-sig", "frequent"):
        space.drop(label)
    return out


def sketches(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each set, in words of 64 bits, the parities of its shingles in BITS places."""
    each = BITS // 64
    out = np.zeros((len(at) - 1) * each, U64)
    place = mix(values ^ U64(0x5DEECE66D))
    word = np.repeat(np.arange(len(at) - 1) * each, np.diff(at)) + ((place >> U64(6)) % U64(each)).astype(np.int64)
    np.bitwise_xor.at(out, word, U64(1) << (place & U64(63)))
    return out.reshape(-1, each)


def wanted_sets(docs: DataFrame, wanted: DataFrame, space: Workspace) -> str:
    """Name of a table (doc, n, tokens, sketch's words) of the wanted documents (column id), bucketed by doc.

    The texts arrive dealt out by id, so writing the buckets moves nothing, and a later join
    deals out its pairs only, never the sets.
    """
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, at in _sets(batch):
                words = sketches(values, at).view(np.int64)
                arrays = [batch.column(0).slice(a, b - a), pa.array(np.diff(at).astype(np.int32)), lists(values, at), *(pa.array(np.ascontiguousarray(w)) for w in words.T)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n", "tokens", *SKETCH])

    texts = docs.join(wanted, "id", "left_semi").select("id", "text")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = f"shingle_sets_{uuid.uuid4().hex}"
    with shuffle_cleanup(docs.sparkSession):
        texts.mapInArrow(run, f"doc {id_type}, n int, tokens array<bigint>, " + ", ".join(f"{s} bigint" for s in SKETCH)).write.bucketBy(buckets, "doc").sortBy("doc").option("path", f"{space.path}/sets").saveAsTable(name)
    return name


def size_fits(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def sketch_fits(n: Column, other_n: Column, mark: str) -> Column:
    """Whether the sketches (the other's words begin with ``mark``) differ in no more places than sets that link in shingles.

    100 * both >= PERCENT * union, and both = (n + other_n - apart) / 2, union = (n + other_n + apart) / 2.
    """
    apart = [F.bit_count(F.col(s).bitwiseXOR(F.col(mark + s))) for s in SKETCH]
    most = (100 - PERCENT) * (n + other_n)
    half = sum(apart[1 : len(apart) // 2], apart[0])
    return ((100 + PERCENT) * half <= most) & ((100 + PERCENT) * sum(apart[len(apart) // 2 :], half) <= most)


def compared(pairs: DataFrame, sets: DataFrame, space: Workspace, label: str) -> DataFrame:
    """The pairs (x, y) that link.

    y's set goes along with the pair to x. If one x is in very many pairs, that join can be
    split: both its sides are dealt out, and x's sets are those of the few that are an x.
    """
    heads = space.keep(sets.select("doc", "n", "tokens").join(pairs.select(F.col("x").alias("doc")).distinct(), "doc", "left_semi"), f"{label}-heads")
    left = heads.select(F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    out = pairs.join(right, "y").join(left, "x").where(100 * both >= PERCENT * (F.col("nx") + F.col("ny") - both))
    out = space.keep(out.select("x", "y"), label)
    space.drop(f"{label}-heads")
    return out


def live_signatures(rows: DataFrame, draw: int) -> DataFrame:
    """(sig, lead, lead_n, lead_root) of the signatures that more than one component has.

    Copies share many signatures that nobody else has: of signatures with the same members
    one is kept. Members are told apart by 128 bits of exclusive-ors and
    62 bits of sums of their hashes, besides their number, the ends of their roots and the lead.
    """
    h, g = F.xxhash64("doc"), F.xxhash64(F.lit("second"), "doc")
    lead = F.max(F.struct("score", F.xxhash64(F.lit(draw), "doc").alias("draw"), "doc", "n", "root")).alias("lead")
    marks = [F.count("*").alias("size"), F.bit_xor(h).alias("x1"), F.bit_xor(g).alias("x2"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))).alias("s1"), F.sum(F.shiftrightunsigned(h, 33)).alias("s2")]
    live = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), lead, *marks).where(F.col("lo") != F.col("hi"))
    live = live.select("sig", F.col("lead.doc").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.root").alias("lead_root"), "size", "lo", "hi", "x1", "x2", "s1", "s2")
    same = live.columns[1:]
    return live.groupBy(*same).agg(F.min("sig").alias("sig")).select("sig", *same[:3])


def more_leads(rows: DataFrame, many: int) -> DataFrame:
    """(sig, x, nx, rx, x's sketch): of each signature about ``many`` of the members outside the lead's component, drawn by hash; all if there are no more."""
    others = rows.where(F.col("root") != F.col("lead_root"))
    count = others.groupBy("sig").agg(F.count("*").alias("others"))
    drawn = others.join(count, "sig").where(F.pmod(F.xxhash64(F.lit(many), "sig", "doc"), F.col("others")) < many)
    return drawn.select("sig", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), *(F.col(s).alias(f"x{s}") for s in SKETCH))


def links(rows: DataFrame, sets: DataFrame, space: Workspace) -> DataFrame:
    """(node, root) of the documents that links connect, by the smallest of each component.

    In each of the first rounds every signature's members are compared with one of them, its
    lead: the one whose signatures most documents hold, in a group of edited copies the original
    or near it. Members of one component need no more comparison. In later rounds several
    members outside the lead's component are leads. Leads are compared with all members that
    they can link with by size, sketch and component, and then leave. A signature ends when
    all are of one component; more leads from round to round keep the number of rounds to the
    logarithm of its members. The last round's components are the result, and a round without a
    link keeps those it has: the driver remembers the plan and tasks of every step.
    """
    tree, made, k, many = None, 0, 0, 1
    score = space.keep(rows.groupBy("doc").agg(F.sum("held").alias("score")), "score")
    words = space.keep(sets.select("doc", *SKETCH), "sketches")
    rows = rows.join(score, "doc").select("sig", "doc", "n", "score", F.col("doc").alias("root"))
    while True:
        rows = space.keep(rows.join(live_signatures(rows, k), "sig"), f"live{k}")
        if k and rows.isEmpty():
            return tree
        if k:  # what this round's rows were made from
            for label in (f"live{k - 1}", f"leads{k - 1}", f"compared{k - 1}"):
                space.drop(label)
        if many == 1:
            pairs = rows.where((F.col("lead") != F.col("doc")) & (F.col("root") != F.col("lead_root")) & size_fits(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("x"), F.col("doc").alias("y"), F.col("lead_n").alias("nx"), F.col("n").alias("ny")).distinct()
            pairs = pairs.join(words.withColumnRenamed("doc", "y"), "y").join(words.select(F.col("doc").alias("x"), *(F.col(s).alias(f"x{s}") for s in SKETCH)), "x").where(sketch_fits(F.col("nx"), F.col("ny"), "x")).select("x", "y")
        else:
            with_words = rows.join(words, "doc")
            leads = space.keep(more_leads(with_words, many), f"leads{k}")
            fit = (F.col("x") != F.col("doc")) & (F.col("root") != F.col("rx")) & size_fits(F.col("n"), F.col("nx")) & sketch_fits(F.col("n"), F.col("nx"), "x")
            pairs = with_words.select("sig", "doc", "n", "root", *SKETCH).join(leads, "sig").where(fit).select("x", F.col("doc").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "x", "y").groupBy("a", "b").agg(F.min("x").alias("x")).select("a", "b", "x", F.when(F.col("x") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("y"))
        if k:  # the pairs of all rounds before are one scan, so a round's plan does not grow with their number
            pairs = pairs.join(space.read("pairs0", pairs.schema, *(f"pairs{i}" for i in range(1, k))).select("a", "b"), ["a", "b"], "left_anti")
        pairs = space.keep(pairs, f"pairs{k}")
        found = compared(pairs.select("x", "y"), sets, space, f"compared{k}")
        rows = rows.where(F.col("doc") != F.col("lead")) if many == 1 else rows.join(leads.select("sig", F.col("x").alias("doc")), ["sig", "doc"], "left_anti")
        rows = rows.select("sig", "doc", "n", "score", "root")
        if tree is None or not found.isEmpty():
            new = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            edges = new if tree is None else new.unionByName(tree.select(F.col("node").alias("a"), F.col("root").alias("b")))
            tree = components(edges, space, f"round{k}")
            if k:
                space.drop_like(f"round{made}-small")
            made = k
            root = tree.select(F.col("node").alias("doc"), F.col("root").alias("found"))
            rows = rows.join(root, "doc", "left").select("sig", "doc", "n", "score", F.coalesce("found", "root").alias("root"))
        k += 1
        many = many * LEADS_GROW if k >= STAR_ROUNDS else 1


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (the smallest id reachable by links) of every document.

    A set has the distinct five-word shingles (A-Z lower-cased, words split at ASCII white
    space); with fewer words the whole sequence is one shingle; null, empty and blank texts
    have none and link with nothing. Equal sets link. Rows that repeat an id are one document
    each, and share the id. Rows without an id link with nothing and have no component.
    """
    space = Workspace(docs.sparkSession, "setjoin")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    nodes = space.keep(docs.mapInArrow(_nodes, "id " + docs.schema["id"].dataType.simpleString() + ", node bigint, node2 bigint, n bigint"), "nodes")
    texts = docs.where(F.col("id").isNotNull())
    firsts = space.keep(nodes.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("node", "node2").agg(F.min("id").alias("id")), "firsts")
    rows = members(texts, frequent_shingles(texts, space), firsts, space)
    sets = wanted_sets(texts, rows.select(F.col("doc").alias("id")).distinct(), space)
    try:
        tree = links(rows, docs.sparkSession.table(sets), space)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {sets}")
        space.drop("sets")
    root = tree.select(F.col("node").alias("first"), "root")
    classes = firsts.select("node", "node2", F.col("id").alias("first")).join(root, "first", "left").select("node", "node2", F.coalesce("root", "first").alias("component"))
    own = nodes.withColumn("node", F.when(F.col("n") > 0, F.col("node")))
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component"))
    return own.join(classes, ["node", "node2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
