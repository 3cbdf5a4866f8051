"""Sharding by a hypergeometric communication matrix (DataFrame functions only).

A uniform shuffle of all rows into shards of exact sizes, without a global sort. The
input's partitions, in stretches of LINE_ROWS rows, are the lines of a matrix that says
how many rows each line sends to each shard. Its law follows from the rows of the lines
and the sizes of the shards, and it is drawn first: in a tree, so that each draw deals
the rows of a node out among a few children, and draws of one level run side by side.
Then each line permutes its rows and deals them out by its row of the matrix, and each
shard permutes what it has got, in ranges of slots that are themselves drawn. Any division
of the rows into shards is equally likely, so rows of equal text spread over the shards
like others.

Defined cases: a null text has no bytes (size 1, crc 0); null and repeated ids are
rows like others, told apart by all their columns; fewer rows than shards leave shards
empty; an empty table gives an empty result; other columns are ignored, and kept with
``carry``. Reruns agree as long as the input is read in the same partitions, as the
files of a table are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.rows import KEY, attach, let, row_key
from tidewell.storage import stored

N_SHARDS = 16
#: Rows of a line at most, as a power of two.
LINE_BITS = 14
#: Children of a node in the tree of draws, about, as a power of two.
FAN_BITS = 5
SEED = 10
#: Rows that a range of a shard's second permutation has, about.
RANGE_ROWS = 16_384


def _uniform(*key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows out of ``total`` are among the ``marked`` ones, for a uniform ``u`` in [0, 1).

    Inversion over the values in the order mode, above, below; their weights follow from
    each other. Values over 12 standard deviations off weigh less than a double resolves.
    """
    spread = F.sqrt(drawn * (marked / total) * (1 - marked / total) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    first = F.struct(total.alias("t"), marked.alias("k"), drawn.alias("n"), (F.ceil(spread * 12) + 12).alias("off"), F.floor((drawn + 1) * ((marked + 1) / (total + 2))).alias("m"))

    def ends(v: Column) -> Column:
        low, high = F.greatest(F.lit(0).cast("long"), v.n - (v.t - v.k)), F.least(v.n, v.k)
        m = F.least(high, F.greatest(low, v.m))
        return F.struct(v.t.alias("t"), v.k.alias("k"), v.n.alias("n"), m.alias("m"), (F.least(high, m + v.off) - m).alias("up"), (m - F.greatest(low, m - v.off)).alias("down"))

    def draw(v: Column) -> Column:
        def above(w, i):  # the weight of m + i from that of m + i - 1
            x = (v.m + i).cast("double")
            return w * (v.k - x + 1) * (v.n - x + 1) / (x * (v.t - v.k - v.n + x))

        def below(w, i):
            x = (v.m - i).cast("double")
            return w * (x + 1) * (v.t - v.k - v.n + x + 1) / ((v.k - x) * (v.n - x))

        def added(weigh, acc, i):
            return let(weigh(acc.w, i), lambda w: F.struct(w.alias("w"), (acc.sum + w).alias("sum")))

        def walked(weigh, sign, acc, i):  # left: weight to go before the value is found
            return let(
                weigh(acc.w, i),
                lambda w: F.struct(w.alias("w"), (acc.left - w).alias("left"), F.when((acc.left >= 0) & (acc.left - w < 0), v.m + i * sign).otherwise(acc.x).alias("x")),
            )

        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        over = F.aggregate(_steps(v.up), zero, lambda a, i: added(above, a, i)).sum
        under = F.aggregate(_steps(v.down), zero, lambda a, i: added(below, a, i)).sum
        start = F.struct(F.lit(1.0).alias("w"), (u * (1 + over + under) - 1).alias("left"), v.m.alias("x"))
        up = F.aggregate(_steps(v.up), start, lambda a, i: walked(above, 1, a, i))
        return let(up, lambda a: F.aggregate(_steps(v.down), F.struct(F.lit(1.0).alias("w"), a.left.alias("left"), a.x.alias("x")), lambda b, i: walked(below, -1, b, i)).x)

    return F.when((total > 0) & (drawn > 0) & (marked > 0), let(let(first, ends), draw)).otherwise(F.lit(0)).cast("long")


def _deal(rooms: DataFrame, children: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(child, sent): each parent's room (rows to send to each shard) dealt out among its children (parent, child, rows).

    Children are drawn one after another, each from what the ones before have left.
    """
    none = F.array().cast("array<bigint>")

    def one(state: Column, x: Column) -> Column:
        def shard(a: Column, s: Column) -> Column:
            k = F.element_at(state.room, s)
            got = hypergeometric(a.total, k, a["rows"], _uniform(F.lit(seed), x.child, s))
            return let(got, lambda g: F.struct((a.total - k).alias("total"), (a["rows"] - g).alias("rows"), F.concat(a.sent, F.array(g)).alias("sent")))

        left = F.aggregate(state.room, F.lit(0).cast("long"), lambda a, r: a + r)
        start = F.struct(left.alias("total"), x["rows"].alias("rows"), none.alias("sent"))
        sent = F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, shard).sent
        return let(sent, lambda g: F.struct(F.zip_with(state.room, g, lambda r, y: r - y).alias("room"), F.concat(state.out, F.array(F.struct(x.child.alias("child"), g.alias("sent")))).alias("out")))

    start = F.struct(F.col("room"), F.array().cast("array<struct<child:bigint,sent:array<bigint>>>").alias("out"))
    each = children.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("child", "rows"))).alias("children")).join(rooms, "parent")
    return each.select(F.explode(F.aggregate("children", start, one).out).alias("x")).select("x.child", "x.sent")


def communication_matrix(lines: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """(line, ends): how many rows the line sends to shards up to each; ``lines`` has (line, rows).

    Lines hang below nodes by the last bits of their hash, FAN_BITS more on each level.
    """
    lines = stored(lines.withColumn("hash", F.xxhash64(F.lit(seed), "line")), "lines")
    count, total = lines.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    levels = max(0, (count - 1).bit_length() - 1) // FAN_BITS
    node = lambda level: F.col("hash").bitwiseAND(F.lit((1 << FAN_BITS * level) - 1))
    spark = lines.sparkSession
    rooms = spark.range(1).select(F.col("id").alias("parent"), F.array(*[F.lit(total // n_shards + (s < total % n_shards)).cast("long") for s in range(n_shards)]).alias("room"))
    for level in range(1, levels + 1):
        children = lines.groupBy(node(level - 1).alias("parent"), node(level).alias("child")).agg(F.sum("rows").alias("rows"))
        rooms = stored(_deal(rooms, children, n_shards, seed + level), f"matrix_{level}").select(F.col("child").alias("parent"), F.col("sent").alias("room"))
    drawn = _deal(rooms, lines.select(node(levels).alias("parent"), F.col("line").alias("child"), "rows"), n_shards, seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda s: F.aggregate(F.slice("sent", F.lit(1), s), F.lit(0).cast("long"), lambda a, y: a + y))
    return drawn.select(F.col("child").alias("line"), ends.alias("ends"))


def shard_rows(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, carry: bool = False, line_bits: int = LINE_BITS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of ``docs``; with ``carry``, all its columns, shard and slot.

    Decisions are made on narrow rows; with ``carry`` the texts are joined to them last and move once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftright(F.monotonically_increasing_id(), line_bits).alias("line"),
        (row_key(docs) if carry else F.lit("")).alias(KEY),
    )
    placed = stored(narrow, "placed")  # which line a row was in must not change with a repeated task
    matrix = stored(communication_matrix(placed.groupBy("line").agg(F.count("*").alias("rows")), n_shards, seed), "matrix")
    local = W.partitionBy("line").orderBy(F.xxhash64(F.lit(seed), "line", "doc_id", "size", "text_crc32", KEY), "doc_id", "text_crc32", KEY)
    dealt = placed.withColumn("nth", F.row_number().over(local)).join(matrix, "line")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("nth")))).drop("ends")
    n = 1 << max(0, (max(placed.count(), 1) // n_shards // RANGE_ROWS).bit_length())
    dealt = dealt.withColumn("draw", F.xxhash64(F.lit(seed + 1), "line", "nth"))
    dealt = dealt.withColumn("range", F.pmod(F.shiftrightunsigned("draw", 40), F.lit(n)))
    dealt = stored(dealt, "dealt")
    starts = dealt.groupBy("shard", "range").agg(F.count("*").alias("rows"))
    starts = starts.select("shard", "range", (F.sum("rows").over(W.partitionBy("shard").orderBy("range")) - F.col("rows")).alias("first"))
    permuted = dealt.withColumn("slot", F.row_number().over(W.partitionBy("shard", "range").orderBy("draw", "line", "nth")) - 1).join(starts, ["shard", "range"])
    permuted = permuted.withColumn("slot", (F.col("first") + F.col("slot")).cast("long"))
    if carry:
        return attach(docs, permuted.select(KEY, "shard", "slot"))
    return permuted.select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, file_rows: int = RANGE_ROWS, **options) -> None:
    """``docs`` under ``path``, a folder per shard; each file holds ``file_rows`` rows of following slots, in order."""
    rows = shard_rows(docs, carry=True, **options).withColumn("_part", F.floor(F.col("slot") / file_rows))
    parts = rows.select("shard", "_part").distinct().count()
    sorted_rows = rows.repartition(max(parts, 1), "shard", "_part").sortWithinPartitions("shard", "slot").drop("_part")
    sorted_rows.write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    rows = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
