"""MinHash near-duplicates by a signature-coordinate inverted join.

1. One pass over the texts gives each document's shingle-set size, a 128-bit digest of the set and a MinHash
   signature of ``COORDINATES`` values. Documents with the same set form a class, named by its least doc_id.
2. Each class is posted under its (coordinate, value) pairs. Two sets at the similarity sought agree in at
   least ``MATCHES`` coordinates but for a chance of about 2e-10 a pair, so values that occur once and classes with fewer
   than ``MATCHES`` shared values are skipped, and a class is posted only under the rarest
   ``n - MATCHES + 1`` of its n shared values (prefix): any pair with enough collisions meets there. Values
   that very many documents share (a common passage) thus stay out of the lists unless a document has little else.
3. In each list, every class is first paired with the list's most central class alone. Pairs are kept when their sizes allow the similarity and their signatures collide
   often enough, and are confirmed on the full sets. Classes already joined need no further pairs; those that
   still meet classes of other components are posted once more, now under the rarest of their shingles as an exact
   prefix filter, and what meets there across components is compared on the full sets whatever the signatures say.
4. Links are joined to components; each document is labelled with the least doc_id of its component.

Very long texts are read whole. Columns beside doc_id and text are not read; :func:`deduplicated` keeps them as they are, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeweave.llm.components import components
from takeweave.llm.shinglesets import COORDINATES, SHINGLE, ShingleSets
from takeweave.session import discard, written

#: Of 48 coordinates two sets of similarity 0.75 agree in 36 on average with deviation 3; fewer than 16 agree in one of about 4,000,000,000 such pairs.
MATCHES = 16
PERCENT = 75
#: Rounds that pair the members of long lists with few others each, before what is left is compared in full.
NEIGHBOUR_ROUNDS = 1
REACH = 4
SHORT_LIST = 8
BUCKET = 512
_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>"


def _sign_task(k: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(k, coordinates)
        for batch in batches:
            docs = batch.column(0)
            for a, b, hashes, sizes in sets.of_column(batch.column(1)):
                d1, d2 = sets.digests(hashes, sizes)
                sig = sets.signatures(hashes, sizes)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * coordinates), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(d1), pa.array(d2), flat], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return run


def _set_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(k, 1)
        for batch in batches:
            nodes = batch.column(0)
            for a, b, hashes, sizes in sets.of_column(batch.column(1)):
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([nodes.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], names=["node", "shingles"])

    return run


def collisions(a: Column, b: Column) -> Column:
    """Coordinates in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


class _Join:
    """State of one near-duplicate run: postings, signatures and sets of the classes that share enough values."""

    def __init__(self, docs: DataFrame, classes: DataFrame, matches: int, percent: int, k: int):
        self.matches, self.percent = matches, percent
        tokens = classes.select("node", F.col("n_shingles").alias("n"), F.posexplode("sig").alias("c", "v")).select("node", "n", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v")).alias("token"))
        shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        ranked = tokens.join(shared, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"), F.sum("df").alias("weight"))
        prefix = ranked.where(F.size("ts") >= matches).select("node", "n", "weight", F.explode(F.slice("ts", F.lit(1), F.size("ts") - matches + 1)).alias("t"))
        self.postings = written(prefix.select("node", "n", "weight", "t.token"), "postings")
        members = self.postings.select("node").distinct()
        self.signatures = written(classes.join(members, "node", "left_semi").select("node", "n_shingles", "sig"), "signatures")
        texts = docs.join(members.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
        self.sets = written(texts.mapInArrow(_set_task(k), "node long, shingles array<long>"), "sets")

    def pivots(self, lists: DataFrame) -> DataFrame:
        """Pairs of each list's most central class (the one with the most shared values) with the list's other classes."""
        best = lists.groupBy("token").agg(F.min(F.struct((-F.col("weight")).alias("r"), F.col("node"), F.col("component"))).alias("p"))
        met = lists.join(best, "token").where("node <> p.node and component <> p.component")
        return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()

    def neighbours(self, lists: DataFrame, turn: int) -> DataFrame:
        """Pairs of the members of long lists with the next ``REACH`` members of another component, in an order drawn anew for each list and turn.

        Long lists are dealt into buckets of about ``BUCKET`` members, so the pairs grow with the lists' lengths and no task gets a whole list.
        """
        size = F.ceil(F.col("members") / BUCKET)
        dealt = lists.where(F.col("members") > SHORT_LIST).withColumn("bucket", F.pmod(F.xxhash64("node", F.lit(turn)), size))
        order = Window.partitionBy("token", "bucket").orderBy(F.xxhash64("node", "token", F.lit(turn)), "node")
        ahead = F.array(*[F.lead(F.struct("node", "component", "n", "left"), d).over(order) for d in range(1, REACH + 1)])
        met = dealt.select("node", "component", "n", "left", F.filter(ahead, lambda x: x.isNotNull()).alias("ahead"))
        able = F.filter("ahead", lambda x: (x["component"] != F.col("component")) & self.reachable(F.col("n"), F.col("left"), x["n"], x["left"]))
        met = met.select("node", F.explode(able).alias("x"))
        return met.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct()

    def exact_lists(self, lists: DataFrame) -> DataFrame:
        """Postings (node, n, token) of the classes in ``lists`` under their shingles, again by prefix.

        A class of n shingles shares at least ``need`` = percent * n / 100 of them with any class it is linked to. Shingles of one class
        alone are skipped, and of the others it is posted under the rarest ``shared - need + 1``; a class with fewer shared shingles than
        it needs is skipped. Copies of one text that differ in more than they may meet in no list, however many they are.
        """
        at = lists.select("node").distinct().join(self.sets, "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
        shared = at.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        ranked = at.join(shared, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
        need = F.floor((self.percent * F.col("n") + 99) / 100).cast("int")
        prefix = ranked.where(F.size("ts") >= need).select("node", "n", F.size("ts").alias("shared"), F.posexplode(F.slice("ts", F.lit(1), F.size("ts") - need + 1)).alias("i", "t"))
        return written(prefix.select("node", "n", "t.token", (F.col("shared") - F.col("i")).alias("left")), "exact-lists")

    def reachable(self, n1: Column, left1: Column, n2: Column, left2: Column) -> Column:
        """Whether two classes that first meet at this token can be similar: they share no more than the tokens left to both from here on."""
        return (100 + self.percent) * F.least(left1, left2) >= self.percent * (n1 + n2)

    def rest(self, lists: DataFrame) -> DataFrame:
        """Pairs of classes that meet in a list, lie in different components and can still be similar.

        Long lists are dealt into buckets of about ``BUCKET`` members, each of which is joined with the whole list on a key of its own.
        """
        size = F.ceil(F.col("members") / BUCKET)
        other = lists.select("token", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("bucket"), F.col("node").alias("n2"), F.col("component").alias("c2"), F.col("n").alias("s2"), F.col("left").alias("l2"))
        able = self.reachable(F.col("n"), F.col("left"), F.col("s2"), F.col("l2"))
        return lists.withColumn("bucket", F.pmod(F.xxhash64("node"), size)).join(other, ["token", "bucket"]).where((F.col("component") < F.col("c2")) & able).select(F.least("node", "n2").alias("a"), F.greatest("node", "n2").alias("b")).distinct()

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Of pairs that met under signature values: those that sizes and the number of collisions allow."""
        sig = self.signatures
        left = pairs.join(sig.toDF("a", "na", "sa"), "a").join(sig.toDF("b", "nb", "sb"), "b")
        sized = (100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")) & (collisions(F.col("sa"), F.col("sb")) >= self.matches)
        return left.where(sized).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the full sets confirm."""
        kept = written(pairs, "pairs")
        full = kept.join(self.sets.toDF("a", "xa"), "a").join(self.sets.toDF("b", "xb"), "b")
        both = F.size(F.array_intersect("xa", "xb"))
        return full.where(100 * both >= self.percent * (F.size("xa") + F.size("xb") - both)).select("a", "b")


def _spanning(named: DataFrame) -> DataFrame:
    """Of postings with their component: the lists that span several components, with their number of members."""
    spread = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("token", "members")
    return named.drop("members").join(spread, "token")


def _same_document(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat a doc_id with different texts."""
    at = full.join(classes.select("n_shingles", "d1", "d2", "node"), ["n_shingles", "d1", "d2"]).select("doc_id", "node")
    several = at.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b <> hi").select("doc_id", "b")
    return at.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def near_duplicates(docs: DataFrame, matches: int = MATCHES, percent: int = PERCENT, coordinates: int = COORDINATES, k: int = SHINGLE, neighbour_rounds: int = NEIGHBOUR_ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text, ...)``.

    Two documents are linked when ``100 * intersection >= percent * union`` holds for their shingle sets.
    component_id is the least doc_id that links reach, kept tells whether it is the row's own.
    Documents without words (null or empty text) are linked with nothing. Rows that repeat a doc_id are one
    document: its links are those of all its texts. Rows with a null doc_id stay by themselves: component_id
    is null and kept is true. An empty table gives no rows.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    signed = written(plain.mapInArrow(_sign_task(k, coordinates), _SIGNED), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select(F.col("r.doc_id").alias("node"), "n_shingles", "d1", "d2", F.col("r.sig").alias("sig")), "classes")
    join = _Join(plain.where("doc_id is not null"), classes, matches, percent, k)
    links = written(_same_document(full, classes), "own")
    lists = written(_spanning(join.postings.withColumn("component", F.col("node"))), "lists")
    links = links.union(written(join.links(join.alike(join.pivots(lists))), "found"))
    discard(lists)
    labels = written(components(links), "labels")
    named = lambda postings: postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    exact = join.exact_lists(_spanning(named(join.postings)))
    for turn in range(neighbour_rounds + 1):
        lists = written(_spanning(named(exact)), "lists")
        if lists.isEmpty():
            break
        last = turn == neighbour_rounds
        new = written(join.links(join.rest(lists) if last else join.neighbours(lists, turn)), "found")
        discard(lists)
        if not new.isEmpty():
            links = links.union(new)
            labels = written(components(links), "labels")
    for done in (exact, join.postings, join.signatures, join.sets):  # what follows reads the labels alone
        discard(done)
    classed = signed.join(classes.select("n_shingles", "d1", "d2", "node"), ["n_shingles", "d1", "d2"], "left")
    out = classed.join(labels, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of rows whose texts are linked, that of the least doc_id; all columns as they were.

    A row goes by its own text: rows that share a doc_id but not a text are told apart, and of equal texts under one doc_id one row
    stays. Rows without words and rows with a null doc_id stay.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("_n"), docs["doc_id"].cast("long").alias("_id"), F.struct(*[docs[c] for c in docs.columns]).alias("_row")), "rows")
    named = rows.where("_id is not null")
    labels = near_duplicates(named.select(F.col("_n").alias("doc_id"), F.col("_row").getField("text").alias("text")), **params).where("n_shingles > 0").select(F.col("doc_id").alias("_n"), "component_id")
    first = labels.join(named.select("_n", "_id"), "_n").groupBy("component_id").agg(F.min(F.struct("_id", "_n")).alias("x")).select(F.col("x._n").alias("_n"))
    gone = written(labels.select("_n").join(first, "_n", "left_anti"), "gone")
    return rows.join(gone, "_n", "left_anti").select("_row.*")
