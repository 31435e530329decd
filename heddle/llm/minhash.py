"""Near-duplicates by circulant MinHash, banding and exact verification.

Documents with one and the same shingle set form a class: their SHA-256 over the whole
sorted set is equal, which confirms it; only classes are compared, under the row number of
their first row. Signatures (``BANDS`` x ``ROWS`` coordinates from two
permutations) are cut into bands; classes that share a band key are candidates. With 32
bands of 4 rows a pair at similarity 0.8 is missed with probability 5e-8 (0.85: 5e-11).

No bucket is expanded into all its pairs. Each bucket has one centre, the class with the
most company in all its buckets, and each member x is verified against its centre c on
full sets. With A_x = x - c and R_x = c - x, a pair (x, y) of a bucket that is not joined
through the centre has a member, say x, below the threshold t with c, and it can only be
linked in one of two ways, both found exactly:
  1. x and y share added shingles: at least a = (t (|y| + |A_x|) - |x n c|) / (1 + t) of
     them (and one), so the rarest they share is among the |A| - a + 1 rarest of both;
  2. they share none: then t (|y| + |A_x|) <= |x n c|, a bound on |y| just below |c|.
These pairs are verified too, unless they are in one component already. So no link
between different texts is lost, and a bucket of n near copies costs about n pairs.

Null or empty texts, or texts of white space, have an empty set and no links. Fewer
words than a shingle: the whole sequence is one shingle. Repeated rows fall into one
class. Rows without doc_id take part; a component's id is its smallest non-null doc_id.
Texts of any length are compared whole. An empty table gives no rows. Only the id and text
columns are read; ``deduplicate`` returns all columns, whatever their names.

A centre's set goes to its members in as many copies as it has ``SHARE`` members, each for
a share of them, so that a class with a third of all company is no single task's work.
Tables of a run are removed when the next ones are written.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm import shingles as S
from heddle.llm.chunks import slices
from heddle.llm.common import Scratch, materialise
from heddle.llm.components import components

BANDS, ROWS, WIDTH = 32, 4, 5
#: Rows broadcast instead of joined by a shuffle: at most this many (an id, and for the sets up to
#: 32 centres of 12 bytes).
BROADCAST_ROWS = 100_000
#: Members compared with one copy of their centre's set.
SHARE = 2048


def described(text: Column) -> Column:
    """Struct: n_shingles, the set's key, band keys (none for an empty set)."""

    @F.arrow_udf("n_shingles long, set_key binary, bands array<long>")
    def describe(texts: pa.Array) -> pa.Array:
        done = []
        for part in slices(texts):
            sets = [S.shingle_set(h, WIDTH) for h in S.word_hashes(part)]
            bands = S.band_keys(S.circulant_signatures(sets, BANDS * ROWS), ROWS)
            none = bands[0][:0]
            columns = [[len(s) for s in sets], [S.set_key(s) for s in sets], [b if len(s) else none for b, s in zip(bands, sets, strict=True)]]
            done.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["n_shingles", "set_key", "bands"]))
        return pa.concat_arrays(done)

    return describe(text)


def full_set(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def shingled(texts: pa.Array) -> pa.Array:
        done = [pa.array([S.shingle_set(h, WIDTH).view("int64") for h in S.word_hashes(part)], pa.list_(pa.int64())) for part in slices(texts)]
        return pa.concat_arrays(done)

    return shingled(text)


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (x, y) with the share each is compared in, and the number of shares of each y."""
    shares = pairs.groupBy("y").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    return pairs.join(shares, "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("shares")).cast("int").alias("share")), shares


def _met(left: DataFrame, centres: DataFrame) -> DataFrame:
    """left (x, sx, y, share) against centres (y, sy, shares): sizes of both sets, their intersection, and x without y."""
    copies = centres.select("y", "sy", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    both = left.join(copies, ["y", "share"]).select("x", "y", F.size("sx").cast("long").alias("nx"), F.size("sy").cast("long").alias("ny"), F.array_except("sx", "sy").alias("added"))
    return both.withColumn("inter", F.col("nx") - F.size("added"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Any pairs (x, y) compared on full sets."""
    dealt, shares = _dealt(pairs)
    left = dealt.join(sets.select(F.col("cls").alias("x"), F.col("s").alias("sx")), "x")
    return _met(left, shares.join(sets.select(F.col("cls").alias("y"), F.col("s").alias("sy")), "y"))


def _linked(similarity: int) -> Column:
    return 100 * F.col("inter") >= similarity * (F.col("nx") + F.col("ny") - F.col("inter"))


def _residual(checked: DataFrame, reached: DataFrame, similarity: int, scratch: Scratch) -> DataFrame:
    """Pairs (x, y) beside the stars that may be linked and are in different components."""
    t = similarity / 100
    comp = reached.withColumnRenamed("node", "cls")
    placed = checked.join(comp.select(F.col("cls").alias("x"), "component"), "x", "left").select("x", F.col("y").alias("c"), "nx", "ny", "inter", "added", "linked", F.coalesce("component", "x").alias("comp"))
    placed = scratch.keep(placed, "placed")
    # 1: additions shared by classes of one centre, rarest first. If x and y share a of them,
    # the rarest shared one stands at place |A| - a + 1 or before in both.
    # Both readers of this exchange use all its columns under the same filters, so that it is written once.
    shingle = placed.where("c IS NOT NULL AND x IS NOT NULL").select("c", "x", "comp", F.explode("added").alias("e")).repartition("c", "e")
    # an addition within one component links nothing
    shared = shingle.groupBy("c", "e").agg(F.count("x").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("df > 1")
    # places are counted from the end, so that additions of one class alone, the rarest, need not be there
    back = F.row_number().over(Window.partitionBy("c", "x").orderBy(F.desc("df"), F.desc("e")))
    ranked = shingle.join(shared, ["c", "e"]).select("c", "x", "comp", "e", (F.col("lo") != F.col("hi")).alias("apart"), back.alias("back")).where("apart")
    whole = placed.select("c", "x", "nx", "linked", "inter", F.size("added").alias("na"))
    ranked = ranked.join(whole, ["c", "x"]).withColumn("at", F.col("na") + 1 - F.col("back"))
    ranked = scratch.keep(ranked.select("c", "e", "x", "nx", "comp", "linked", "inter", "na", "at"), "ranked")
    own = placed.where(~F.col("linked"))
    added = F.size("added")
    least = lambda n, na, inter: F.ceil((t * (F.col(n) + F.col(na)) - F.col(inter)) / (1 + t) - 1e-9)
    need = F.greatest(F.lit(1), least("yn", "xa", "xi"), least("xn", "ya", "yi"))
    fits = (F.col("xn") >= t * F.col("yn") - 1e-9) & (F.col("yn") >= t * F.col("xn") - 1e-9) & (F.col("xc") != F.col("yc"))
    side = lambda k: ["c", "e", F.col("x").alias(k), F.col("nx").alias(f"{k}n"), F.col("comp").alias(f"{k}c"), F.col("inter").alias(f"{k}i"), F.col("na").alias(f"{k}a"), F.col("at").alias(f"{k}t")]
    first = ranked.where(~F.col("linked")).select(side("x")).join(ranked.select(side("y")), ["c", "e"]).where(fits & (F.col("xt") <= F.col("xa") - need + 1) & (F.col("yt") <= F.col("ya") - need + 1)).select("x", "y")
    # 2: sizes just below the centre's
    most = F.floor(F.col("inter") / t - added + 1e-9)
    lowest = F.ceil(t * F.col("nx") - 1e-9)
    small = own.where(lowest <= F.least(most, F.col("ny"))).select("c", "x", F.col("nx").alias("xn"), F.col("comp").alias("xc"), F.explode(F.sequence(lowest, F.least(most, F.col("ny")))).alias("yn"))
    second = small.join(placed.select("c", F.col("x").alias("y"), F.col("nx").alias("yn"), F.col("comp").alias("yc")), ["c", "yn"]).where(fits).select("x", "y")
    pairs = first.unionByName(second).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    done = checked.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    return pairs.join(done, ["x", "y"], "left_anti")


def near_duplicates(docs: DataFrame, similarity: int, *, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """One row per document: uid, doc_id, n_shingles, component_id, first (one row of each component is).

    Row numbers must not change when rows are read again, so without ``uid_col`` (a unique
    column of a stored table) ids and texts are first written with numbers of their own.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        keep = scratch.keep
        text = F.col(text_col).alias("text")
        if uid_col is None:
            source = keep(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), text), "documents")
        else:
            source = docs.select(F.col(uid_col).alias("uid"), F.col(id_col).alias("doc_id"), text)
        rows = keep(source.select("uid", "doc_id", described(F.col("text")).alias("d")).select("uid", "doc_id", "d.*"), "rows")
        full = rows.where("n_shingles > 0")
        # a class's first row: smallest doc_id (null last), then uid; its uid names the class
        first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "uid", "bands")).alias("first")
        least = F.struct("first.null_id", "first.doc_id", "first.uid").alias("least")
        classes = keep(full.groupBy("set_key").agg(first).select("set_key", least, F.col("first.uid").alias("cls"), F.col("first.bands").alias("bands")), "classes")
        # one exchange for the sizes and for the members: both use all its columns
        banded = classes.select("cls", F.explode("bands").alias("bucket")).repartition("bucket")
        sizes = banded.groupBy("bucket").agg(F.count("cls").alias("size")).where("size > 1")
        members = keep(banded.join(sizes, "bucket"), "members")
        company = members.groupBy("cls").agg(F.sum("size").alias("company"))
        centres = members.join(company, "cls").groupBy("bucket").agg(F.max(F.struct("company", "cls")).alias("c")).select("bucket", F.col("c.cls").alias("c"))
        star = keep(members.join(centres, "bucket").where("cls != c").select(F.col("cls").alias("x"), F.col("c").alias("y")).distinct(), "star")
        scratch.drop(members)

        # The classes of the stars with their full sets, each with its centres (one a band at most) and,
        # if it is one, its shares: a set then goes to its centres without a join on its own id.
        dealt, shares = _dealt(star)
        centred = dealt.groupBy(F.col("x").alias("cls")).agg(F.collect_list(F.struct("y", "share")).alias("centres"))
        wanted = keep(centred.join(shares.withColumnRenamed("y", "cls"), "cls", "full"), "wanted")
        few = wanted.count() <= BROADCAST_ROWS
        chosen = source.select("uid", "text").join(F.broadcast(wanted) if few else wanted, F.col("uid") == F.col("cls"))
        sets = keep(chosen.select("cls", "centres", "shares", full_set(F.col("text")).alias("s")), "sets")

        left = sets.select(F.col("cls").alias("x"), F.col("s").alias("sx"), F.explode("centres").alias("p")).select("x", "sx", "p.y", "p.share")
        centre = sets.where("shares IS NOT NULL").select(F.col("cls").alias("y"), F.col("s").alias("sy"), "shares")
        checked = keep(_met(left, centre).withColumn("linked", _linked(similarity)), "checked")
        links = checked.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
        reached = components(links, scratch)
        more = keep(_compared(keep(_residual(checked, reached, similarity, scratch), "residual"), sets).where(_linked(similarity)).select(F.col("x").alias("a"), F.col("y").alias("b")), "more")
        if not more.isEmpty():
            reached = components(links.unionByName(more), scratch)

        grouped = classes.join(reached.withColumnRenamed("node", "cls"), "cls", "left").select("set_key", "least", F.coalesce("component", "cls").alias("comp"))
        firsts = grouped.groupBy("comp").agg(F.min("least").alias("least"))
        named = keep(grouped.select("set_key", "comp").join(firsts, "comp").select("set_key", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("first_uid")), "named")
        found = rows.join(named, "set_key", "left").select(
            "uid", "doc_id", "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.coalesce(F.col("uid") == F.col("first_uid"), F.lit(True)).alias("first"),
        )
        return scratch.result(found, "near-duplicates")


def deduplicate(docs: DataFrame, similarity: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group, with the columns they came with."""
    own = "__heddle_uid"
    while own in docs.columns:
        own += "_"
    stored = materialise(docs.withColumn(own, F.monotonically_increasing_id()), "documents")
    verdict = near_duplicates(stored, similarity, id_col=id_col, text_col=text_col, uid_col=own)
    dropped = verdict.where(~F.col("first")).select(F.col("uid").alias(own))
    few = dropped.count() <= BROADCAST_ROWS
    return stored.join(F.broadcast(dropped) if few else dropped, own, "left_anti").drop(own)
