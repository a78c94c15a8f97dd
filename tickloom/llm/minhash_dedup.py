"""Near-duplicate documents by a chosen-path set similarity join.

Equal shingle sets are one class from the start. Each class has ``COORDS`` minwise
tokens. A tree sends every class to a node by one token; a large node chooses two
further coordinates (the same for all its members) and branches its members by
their tokens there, again and again, until nodes are small and are compared
exhaustively. ``trees`` independent trees make it unlikely that a pair parts in all:
two sets of similarity 0.85 stay together in a tree with probability 0.82, so eight
trees miss one pair in a million.

Only components are asked for, so a large node first links its members to one of
them; a node whose members are all in one component is done. Whether branching makes a node cheaper is
read off the sizes its children would have; only then do members move, and only into children that hold undecided
ones. A node that branching would not make cheaper is compared in blocks instead: first each block within itself, the
members dealt to blocks at random twice over, which joins a large group of near copies at a cost in proportion to its
members; then every two blocks, but no two of the same component. Signature agreement far below
the threshold rules a pair out (one pair in 300,000 at the threshold, beside the one in a million above). The members
of a block that are left with partners get their full shingle sets, pairs not yet connected are confirmed on them
(as sets of 64-bit hashes of the shingles), and the block gives out a spanning forest: fewer links than members, whatever
the number of pairs.

Defined results: a null, empty or wordless text has no shingles and is alone; a
text of fewer words than a shingle is one shingle; rows that repeat a doc_id count as
rows of their own with the same id; component_id is the smallest non-null doc_id
reachable. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.decontam import Bitmap
from tickloom.llm.graph import components
from tickloom.llm.skew import lookup
from tickloom.llm.store import stored
from tickloom.llm.words import SOLID_WORD, column, hash_spans, pieces, shingles, words_of

COORDS = 256
TREES = 8
SMALL = 256
BLOCK = 256
MANY_PAIRS = 64  # candidates of a block from which all its sets are intersected at once
MATRIX_CELLS = 1 << 25
SLAB_CELLS = 1 << 21  # of that matrix at a time
BLOCK_SHINGLES = 1 << 21  # of the members of a block together, about
DEALS = 2  # times at most that members are dealt to blocks at random, twice over each time
SIGMAS = 4.5  # a pair at the threshold agrees this far below its expectation once in 300,000 times

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(0, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece: (rows, sorted distinct shingle hashes of all rows, where each row's begin, with an end)."""
    for piece in pieces(texts):
        low, starts, ends, firsts = words_of(piece, SOLID_WORD)
        values, owner = shingles(hash_spans(low, starts, ends), firsts, width)
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[fresh], owner[fresh]
        yield np.arange(piece.first, piece.first + piece.n), values, np.searchsorted(owner, np.arange(piece.n + 1))


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, trees: int, with_row: bool = False) -> DataFrame:
    """``doc_id, n, cls, roots, sig`` (and ``row``, all columns): set size, 128-bit name of the set, its first
    ``trees`` minwise tokens, and eight bits of each of ``COORDS`` of them (null without shingles)."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if with_row else []),
    )
    kind = f", row {rows.schema['row'].dataType.simpleString()}" if with_row else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, roots, sigs = [], [], [], []
            for _, values, at in shingle_sets(column(batch, "_text"), width):
                sizes = np.diff(at)
                n.extend(sizes.tolist())
                some = np.flatnonzero(sizes)
                sig = np.zeros((COORDS, len(some)), np.uint32)
                if len(some):
                    for k in range(COORDS):
                        sig[k] = np.minimum.reduceat((((values ^ _XOR[k]) * _ODD[k]) >> np.uint64(32)).astype(np.uint32), at[:-1][some])
                tops = np.ascontiguousarray(sig[:trees].T).astype(np.int64)
                sig = np.ascontiguousarray((sig & np.uint32(0xFF)).T.astype(np.uint8))
                own = iter(range(len(some)))
                for i in range(len(sizes)):
                    names.append(set_key(values[at[i] : at[i + 1]]) if sizes[i] else None)
                    k = next(own) if sizes[i] else None
                    roots.append(None if k is None else tops[k])
                    sigs.append(None if k is None else sig[k].tobytes())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), *batch.columns[2:]],
                names=["doc_id", "n", "cls", "roots", "sig", *batch.schema.names[2:]],
            )

    return rows.mapInArrow(run, f"doc_id long, n long, cls binary, roots array<long>, sig binary{kind}")


def token(sig, coordinate):
    """The minwise token at a coordinate: a byte of the signature."""
    return F.hex(F.substring(sig, coordinate + 1, F.lit(1)))


class Join:
    """One run of the similarity join; tables that later steps read again are stored."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, width: int, threshold: float, trees: int, with_row: bool = False):
        self.docs, self.doc_id, self.text, self.width = docs, doc_id, text, width
        self.spark, self.threshold, self.trees = docs.sparkSession, threshold, trees
        self.floor = threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / COORDS)
        self.rows = stored(signatures(docs, doc_id, text, width, trees, with_row), "signatures")
        known = self.rows.where(F.col("cls").isNotNull())
        classes = known.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("roots").alias("roots"), F.first("sig").alias("sig"))
        self.classes = stored(classes, "classes")
        self.links: DataFrame | None = None
        self.known: DataFrame | None = None

    def fetch_sets(self, wanted: DataFrame) -> DataFrame:
        """``cls, hashes``: full shingle sets of the classes wanted, from the texts again."""
        places = self.classes.join(wanted, "cls", "left_semi").select(F.xxhash64("doc_id").alias("shingle"))
        bitmap = self.spark.sparkContext.broadcast(Bitmap.of(places).bits)
        rows = self.docs.select(
            F.xxhash64(F.col(self.doc_id).cast("long")).alias("place"), F.coalesce(F.col(self.text), F.lit("")).alias("_text")
        )
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filter_ = Bitmap(bitmap.value)
            for batch in batches:
                mine = filter_.has(column(batch, "place").to_numpy().view(np.uint64))
                texts = column(batch, "_text").filter(pa.array(mine))
                names, sets = [], []
                for rows_, values, at in shingle_sets(texts, width):
                    for i in range(len(rows_)):
                        own = values[at[i] : at[i + 1]]
                        if len(own):
                            names.append(set_key(own)), sets.append(own.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "hashes"])

        found = rows.mapInArrow(run, "cls binary, hashes binary").join(wanted, "cls", "left_semi")
        return found.groupBy("cls").agg(F.first("hashes").alias("hashes"))

    def confirm(self, pairs: DataFrame) -> bool:
        """Verify distinct pairs (``a, b``) on full sets; True if any became a link."""
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        if pairs.isEmpty():
            return False
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
        sets = stored(self.fetch_sets(ends), "sets")
        # A class in very many pairs is split by adaptive execution: its set goes to each part.
        whole = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha")), "a")
        whole = whole.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb")), "b")
        percent = round(self.threshold * 100)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.zeros(batch.num_rows, bool)
                ha, hb = column(batch, "ha"), column(batch, "hb")
                for i in range(batch.num_rows):
                    x, y = (np.frombuffer(h[i].as_buffer(), "<u8") for h in (ha, hb))
                    shared = _shared(x, y)
                    good[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([column(batch, c).filter(keep) for c in ("a", "b")], names=["a", "b"])

        return self.add(stored(whole.select("a", "b", "ha", "hb").mapInArrow(run, "a binary, b binary"), "links"))

    def add(self, new: DataFrame) -> bool:
        """Take links up; True if there were any."""
        if new.isEmpty():
            return False
        self.links, self.known = new if self.links is None else self.links.unionByName(new), None
        return True

    def labelled(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("cls"))
        known = labels.select(F.col("node").alias("cls"), "label")
        return rows.join(known, "cls", "left").withColumn("label", F.coalesce("label", "cls"))

    def labels(self) -> DataFrame | None:
        """Components of the links so far; computed again only after new links."""
        if self.known is None and self.links is not None:
            self.known = stored(components(self.links), "labels")
        return self.known

    def grow(self) -> DataFrame:
        """Branch all trees; ``node, cls, n, label, size, shingles, tree`` of the nodes to compare exhaustively (``tree``: of a root, else ``trees``).

        Every class is in its root of every tree; nodes of one class need nothing.
        """
        roots = self.classes.select("cls", "n", F.col("cls").alias("label"), F.posexplode("roots").alias("tree", "token"))
        roots = roots.select("cls", "n", "label", "tree", F.xxhash64("tree", "token").alias("node"))
        sizes = roots.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
        rows = stored(roots.join(sizes, "node"), "level")
        signed = lambda x: stored(by_class(x.drop("tree"), lambda one: one.join(self.classes.select("cls", "sig"), "cls")), "large")
        deep = lambda x: x.select("node", "cls", "n", "label", "size", "shingles", F.lit(self.trees).alias("tree"))
        out, large = rows.where(F.col("size") <= SMALL), rows.where(F.col("size") > SMALL)
        if large.isEmpty():
            return out
        # From here on rows carry what comparing and branching need.
        members = signed(large)
        if self.link_to_one(members):
            members = signed(self.undecided(large))
        while not members.isEmpty():
            rows, dense = self.branch(members)
            out = out.unionByName(deep(dense)).unionByName(deep(rows.where(F.col("size") <= SMALL)))
            members = rows.where(F.col("size") > SMALL)
        return out

    def undecided(self, rows: DataFrame) -> DataFrame:
        """Rows of nodes with members of more than one component, one row a class taking up the component it is in by now.

        Components only grow, so nodes that were settled before stay so and need not be among the rows.
        """
        rows = stored(by_class(rows.drop("label"), lambda one: self.labelled(one, self.labels())), "labelled")
        mixed = rows.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        return stored(rows.join(mixed, "node", "left_semi"), "level")

    def link_to_one(self, large: DataFrame) -> bool:
        """Link the members of each large node to its smallest class where their signatures allow it."""
        first = large.groupBy("node").agg(F.min(F.struct("cls", "n", "sig")).alias("first"))
        pairs = large.select("node", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")).join(first, "node")
        pairs = pairs.select("node", "b", "nb", "sb", F.col("first.cls").alias("a"), F.col("first.n").alias("na"), F.col("first.sig").alias("sa"))
        near = stored(self.agreeing(pairs.where(F.col("a") != F.col("b"))), "near")
        # Worth the confirmation only where it may settle the better part of a node; others branch.
        full = large.groupBy("node").agg(F.first("size").alias("size")).join(near.groupBy("node").agg(F.count("*").alias("m")), "node")
        full = full.where(2 * F.col("m") >= F.col("size")).select("node")
        return self.confirm(near.join(full, "node", "left_semi"))

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        floor, threshold = self.floor, self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (_signature_matrix(column(batch, c)) for c in ("sa", "sb"))
                na, nb = (column(batch, c).to_numpy() for c in ("na", "nb"))
                keep = pa.array(((x == y).mean(1) >= floor) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) * 0.999999))
                yield pa.RecordBatch.from_arrays([column(batch, c).filter(keep) for c in ("node", "a", "b")], names=["node", "a", "b"])

        return pairs.select("node", "a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "node long, a binary, b binary")

    def branch(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of the child nodes, rows of nodes that branching would not make cheaper)."""
        child = lambda k: F.xxhash64("node", F.lit(k), token(F.col("sig"), F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDS)).cast("int")))
        members = large.select("node", "size", "cls", "n", "label", "sig")
        # What the children would be: counted where the members are, before any of them moves.
        of = [F.count("*").alias("m"), F.sum("n").alias("shingles"), F.first("size").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")]
        kinds = [members.groupBy(F.col("node").alias("parent"), child(k).alias("child")).agg(*of) for k in (1, 2)]
        sizes = stored(kinds[0].unionByName(kinds[1]), "children")
        square = lambda c: F.col(c).cast("double") * F.col(c)
        dense = sizes.groupBy("parent").agg((F.sum(square("m")) >= F.first(square("size"))).alias("dense")).where("dense").select("parent")
        dense = stored(dense, "dense")
        mixed = sizes.where(F.col("lo") != F.col("hi")).join(dense, "parent", "left_anti").select("child", F.col("m").alias("size"), "shingles")
        moved = [members.select("cls", "n", "label", "sig", child(k).alias("child")).join(mixed, "child") for k in (1, 2)]
        rows = stored(moved[0].unionByName(moved[1]).withColumnRenamed("child", "node").select("node", "cls", "n", "label", "sig", "size", "shingles"), "level")
        return rows, large.join(dense.select(F.col("parent").alias("node")), "node", "left_semi")

    def compare(self, nodes: DataFrame) -> None:
        """Link the members of each node that belong together, block by block. Only nodes of several blocks are looked at more than once."""
        blocks = _blocks("size", "shingles")
        large = nodes.where(blocks > 1)
        members = large.count()
        for turn in range(DEALS):
            if not members:
                break
            # Dealt twice over at once: the second deal joins what the first has joined in each block.
            hands = [F.pmod(F.xxhash64("cls", "node", F.lit(2 * turn + k)), blocks).cast("int") + F.lit(k) * blocks for k in (0, 1)]
            dealt = large.withColumn("i", F.explode(F.array(*hands)))
            if not self.link_blocks(dealt.withColumns({"j": F.col("i"), "block": F.col("i")}), None):
                break
            large = self.undecided(large)
            before, members = members, large.count()
            # And again only where that settles most of them.
            if 2 * members > before:
                break
        self.link_blocks(self.paired(nodes.where(blocks <= 1).unionByName(large)), nodes)

    def paired(self, rows: DataFrame) -> DataFrame:
        """Each member with every pair of blocks it takes part in (``i, j, block``).

        Components of more than a block get blocks of their own, which are compared neither with themselves nor with
        each other; the other members of a node share blocks.
        """
        blocks = _blocks("size", "shingles")
        small = rows.where(blocks <= 1).withColumns({"i": F.lit(0), "j": F.lit(0), "block": F.lit(0)})
        large = rows.where(blocks > 1)
        if large.isEmpty():
            return small
        shares = large.groupBy("node", "label").agg(F.count("*").alias("m"), F.sum("n").alias("s")).withColumn("own", F.col("m") > BLOCK)
        part = F.when(F.col("own"), F.col("label")).alias("part")
        parts = shares.groupBy("node", part).agg(F.sum("m").alias("m"), F.sum("s").alias("s")).select("node", "part", _blocks("m", "s").alias("blocks"))
        # At most one part a block of members.
        before = Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumns(
            {"first": F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int"), "total": F.sum("blocks").over(Window.partitionBy("node")).cast("int")}
        )
        own, pool = parts.where(F.col("part").isNotNull()), parts.where(F.col("part").isNull())
        of_own = own.select("node", F.col("part").alias("label"), F.col("first").alias("f"), F.col("blocks").alias("b"), F.col("total").alias("t"))
        large = large.join(of_own, ["node", "label"], "left").join(pool.select("node", "first", "blocks", "total"), "node", "left")
        first, blocks = F.coalesce("f", "first"), F.coalesce("b", "blocks")
        others = F.filter(F.sequence(F.lit(0), F.coalesce("t", "total") - 1), lambda x: F.col("f").isNull() | (x < F.col("f")) | (x >= F.col("f") + F.col("b")))
        large = large.withColumn("block", (first + F.pmod(F.xxhash64("cls"), blocks)).cast("int")).withColumn("other", F.explode(others))
        large = large.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        return small.unionByName(large.select(*small.columns))

    def link_blocks(self, rows: DataFrame, nodes: DataFrame | None) -> int:
        """Compare the members of blocks i and j; the number of new links.

        Given the nodes that are compared whole, a pair that shares several roots comes out of the first of them.
        """
        facts = self.labelled(self.classes.select("cls", "sig", "roots"), self.labels())
        if nodes is None:
            facts, tree = facts.withColumn("whole", F.lit(0).cast("long")), F.lit(0)
        else:
            whole = nodes.where(F.col("tree") < self.trees).groupBy("cls").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("whole"))
            facts, tree = facts.join(whole, "cls", "left").withColumn("whole", F.coalesce("whole", F.lit(0).cast("long"))), F.col("tree")
        rows = rows.select("node", "i", "j", "block", "cls", "n", tree.alias("tree"))
        rows = by_class(rows, lambda one: one.join(facts, "cls"))
        floor, threshold, percent = self.floor, self.threshold, round(self.threshold * 100)

        def candidates(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(members of block i, members of block j, which pairs may be linked, how far their signatures agree)."""
            block, i, j = table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            n, label, sig = table["n"].to_numpy(), _codes(table["label"]), _signature_matrix(table["sig"])
            may = label[left][:, None] != label[right][None, :]
            low, high = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
            may &= low >= threshold * high * 0.999999
            if i == j:
                may &= left[:, None] < right[None, :]
            agree = np.zeros(may.shape)
            for at in range(0, len(left), 32):
                rows_ = slice(at, at + 32)
                agree[rows_] = (sig[left[rows_]][:, None, :] == sig[right][None, :, :]).mean(2)
            return left, right, may & (agree >= floor), agree

        def involved(table: pa.Table) -> pa.Table:
            left, right, may, _ = candidates(table)
            tree = table["tree"][0].as_py()
            if tree and may.any():
                # Pairs that share a root of an earlier tree come out there.
                roots = table["roots"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
                whole = table["whole"].to_numpy()
                for t in range(tree):
                    usable = (whole[left] >> t & 1) == 1
                    may &= ~((roots[left, t][:, None] == roots[right, t][None, :]) & usable[:, None])
            wanted = np.zeros(table.num_rows, bool)
            wanted[left[may.any(1)]] = True
            wanted[right[may.any(0)]] = True
            return table.select(kept).filter(pa.array(wanted))

        kept = ["node", "i", "j", "block", "cls", "label", "n", "sig"]
        found = stored(by_group(rows, ["node", "i", "j"], involved, rows.select(*kept).schema), "involved")
        if found.isEmpty():
            return 0
        sets = self.fetch_sets(found.select("cls").distinct())

        def forest(table: pa.Table) -> pa.Table:
            left, right, may, agree = candidates(table)
            names, label = table["cls"].to_pylist(), _codes(table["label"]).tolist()
            hashes = [np.frombuffer(x.as_buffer(), "<u8") for x in table["hashes"]]
            enough = lambda x, y, shared: 100 * shared >= percent * (len(hashes[x]) + len(hashes[y]) - shared)
            x, y = np.nonzero(may)
            inside = _intersections(hashes, left, right) if len(x) > MANY_PAIRS else None
            order = np.argsort(-agree[x, y], kind="stable")
            a, b = [], []
            for p, q in zip(x[order].tolist(), y[order].tolist()):
                one, other = left[p], right[q]
                # What is connected already needs no confirmation.
                if label[one] != label[other]:
                    if enough(one, other, _shared(hashes[one], hashes[other]) if inside is None else int(inside[p, q])):
                        a.append(names[one]), b.append(names[other])
                        old, new = label[other], label[one]
                        label = [new if k == old else k for k in label]
            return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        new = by_group(by_class(found, lambda one: one.join(sets, "cls")), ["node", "i", "j"], forest, "a binary, b binary")
        new = stored(new.distinct(), "links")
        return new.count() if self.add(new) else 0

    def link(self) -> DataFrame:
        """All rounds; ``cls, doc_id, label`` of every class: its smallest doc_id and its component."""
        self.compare(stored(self.grow(), "nodes"))
        return stored(self.labelled(self.classes.select("cls", "doc_id"), self.labels()), "class-labels")

    def result(self) -> DataFrame:
        classes = self.link()
        lowest = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        of_class = classes.join(lowest, "label").select("cls", "component_id")
        some = lookup(self.rows.where(F.col("cls").isNotNull()).select("doc_id", "n", "cls"), of_class, "cls", F.col("doc_id"))
        none = self.rows.where(F.col("cls").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
        out = some.select("doc_id", "n", "component_id").unionByName(none)
        return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

    def representatives(self) -> DataFrame:
        """The input's columns of one row per component, that of the smallest doc_id, and of every row without shingles."""
        first = self.link().groupBy("label").agg(F.min(F.struct("doc_id", "cls")).alias("first")).select("first.cls")
        rows = self.rows.where(F.col("cls").isNotNull()).select("cls", "doc_id", "row").join(first, "cls", "left_semi")
        # Copies combine on the map side; a null doc_id gives way to any other.
        one = rows.groupBy("cls").agg(F.coalesce(F.min_by("row", "doc_id"), F.first("row")).alias("row"))
        none = self.rows.where(F.col("cls").isNull()).select("row")
        return one.select("row").unionByName(none).select("row.*")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two ascending sets have in common."""
    x, y = (x, y) if len(x) > len(y) else (y, x)
    return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())


def _intersections(hashes: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """Sizes of the intersections of all pairs of sets as a product of 0/1 matrices, unless those would be large; some columns at a time."""
    place = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    width = int(place.max(initial=-1)) + 1
    if len(hashes) * width > MATRIX_CELLS:
        return None
    row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    slab = max(1, SLAB_CELLS // len(hashes))
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, width, slab):
        mine = (place >= low) & (place < low + slab)
        m = np.zeros((len(hashes), min(slab, width - low)), np.float32)
        m[row[mine], place[mine] - low] = 1
        shared += m[left] @ m[right].T
    return shared


def _codes(column_: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers."""
    return column_.combine_chunks().dictionary_encode().indices.to_numpy()


def _blocks(members: str, shingles: str) -> Column:
    return F.ceil(F.greatest(F.col(members) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def by_class(rows: DataFrame, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what ``join`` adds to their ``cls``, one row a class while it is joined, however many nodes that is in."""
    others = [c for c in rows.columns if c != "cls"]
    one = join(rows.groupBy("cls").agg(F.collect_list(F.struct(*others)).alias("_at")))
    return one.withColumn("_at", F.explode("_at")).select(*(c for c in one.columns if c != "_at"), "_at.*")


def by_group(rows: DataFrame, keys: list[str], each: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """``each`` over the rows of every combination of ``keys``, which must be few: groups stream through sorted partitions,
    so that very many small ones cost little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            change = np.zeros(max(table.num_rows - 1, 0), bool)
            for key in keys:
                values = table[key].to_numpy()
                change |= values[1:] != values[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist()]
            held = table.slice(edges[-1])
            out = [each(table.slice(a, b - a)) for a, b in zip(edges, edges[1:])]
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from each(held).combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _signature_matrix(column_: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column_ = column_.combine_chunks() if isinstance(column_, pa.ChunkedArray) else column_
    _, offsets, data = column_.buffers()
    if not len(column_):
        return np.zeros((0, COORDS), np.uint8)
    first = np.frombuffer(offsets, np.int32)[column_.offset]
    return np.frombuffer(data, np.uint8)[first : first + len(column_) * COORDS].reshape(-1, COORDS)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, trees: int = TREES
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``. ``threshold`` is taken in whole percent."""
    return Join(docs, doc_id, text, width, threshold, trees).result()


def without_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, trees: int = TREES
) -> DataFrame:
    """``docs`` with one row for each group of near duplicates."""
    return Join(docs, doc_id, text, width, threshold, trees, with_row=True).representatives()
