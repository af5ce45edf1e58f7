"""Addresses against a table of networks: the longest network that holds an address, by one sorted pass over blocks of addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesswatch.functions.ip import ipv4_to_long, ipv6_to_hex
from accesswatch.session import checkpoint_dir

#: Leading bits that make the block of an address, by family. An IPv4 block has 65 536 addresses.
BLOCK = {4: 16, 6: 64}
BITS = {4: 32, 6: 128}


def _with_address(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``_n``, the number of an IPv4 address, ``_d``, the digits of an IPv6 one, and ``_f``, the family.

    They come out of a generator, so the long expressions are computed once, not wherever their result is used.
    """
    both = F.struct(ipv4_to_long(text).alias("_n"), F.when(text.contains(":"), ipv6_to_hex(text)).alias("_d"))
    family = F.when(F.col("_n").isNotNull(), 4).when(F.col("_d").isNotNull(), 6)
    return df.select("*", F.inline(F.array(both))).withColumn("_f", family)


def _with_place(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``_f``, the block ``_a`` of an address and its place there, ``_b``, a number in the order of addresses."""
    parsed = _with_address(df, text)
    half = lambda start: F.conv(F.substring("_d", start, 16), 16, -10).cast("bigint")
    places = {
        "_a": F.when(F.col("_f") == 4, F.expr("_n div 65536")).otherwise(half(1)),
        # Signed numbers are in the order of unsigned ones once their first bit is turned.
        "_b": F.when(F.col("_f") == 4, F.col("_n") % 65536).otherwise(half(17).bitwiseXOR(F.lit(-(2**63)))),
    }
    return parsed.withColumns(places).drop("_n", "_d")


def _cut(number: str, bits: str) -> Column:
    """``number`` without its last ``bits`` bits; all 64 leave 0."""
    return F.expr(f"CASE WHEN {bits} >= 64 THEN 0L ELSE shiftright({number}, CAST({bits} AS INT)) END")


def parse_networks(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """``networks`` with ``_family``, ``_bits``, and the block and place of the first address, ``_a`` and ``_b``; rows that are no
    network are left out. For a network that holds whole blocks ``_a`` is what the numbers of these blocks begin with.

    An address without a length is a network of its own. Bits behind the length are ignored.
    """
    length = F.split_part(F.col(cidr), F.lit("/"), F.lit(2))
    parsed = _with_place(networks, F.split_part(F.col(cidr), F.lit("/"), F.lit(1)))
    full = F.when(F.col("_f") == 4, BITS[4]).otherwise(BITS[6])
    bits = F.when(F.col(cidr).contains("/"), F.when(length.rlike(r"\A[0-9]{1,3}\z"), length.try_cast("int"))).otherwise(full)
    parsed = parsed.withColumn("_bits", bits).where(F.col("_f").isNotNull() & (F.col("_bits") <= full))
    block = F.when(F.col("_f") == 4, BLOCK[4]).otherwise(BLOCK[6])
    parsed = parsed.withColumns({"_above": F.greatest(block - F.col("_bits"), F.lit(0)), "_below": F.least(full - F.col("_bits"), full - block)})
    first = F.when(F.col("_bits") <= block, 0).otherwise(F.expr("shiftleft(shiftright(_b, _below % 64), _below % 64)")).cast("bigint")
    return parsed.withColumns({"_a": _cut("_a", "_above"), "_b": first}).withColumnRenamed("_f", "_family").drop("_above", "_below")


def longest_network(
    df: DataFrame, networks: DataFrame, labels: list[str], ip: str = "IP_Address", cidr: str = "cidr"
) -> DataFrame:
    """``df`` with the ``labels`` of the longest network that holds its address; null if none does.

    Networks of whole blocks are probed with each distinct block, in an equality join with a key per length. The other
    networks lie in one block each. They and the distinct addresses of a block are read in order, and the network of a
    length that may hold an address is the last of its length that began before it. So an address goes through one
    sort, however many lengths there are, and the table may be of any size. An IPv4 block has 65 536 distinct addresses at
    most; those of an IPv6 block (/64) are in one task. Of networks given twice the least labels count. No row is
    dropped or repeated.
    """
    checkpoint_dir(df.sparkSession)
    held = parse_networks(networks, cidr).groupBy("_family", "_bits", "_a", "_b").agg(F.min(F.struct(*labels)).alias("_labels")).checkpoint()
    lengths = [tuple(r) for r in held.select("_family", "_bits").distinct().orderBy("_family", "_bits").collect()]
    if not lengths:
        kinds = dict(networks.dtypes)
        return df.withColumns({c: F.lit(None).cast(kinds[c]) for c in labels})
    block = F.when(F.col("_family") == 4, BLOCK[4]).otherwise(BLOCK[6])
    families = sorted({f for f, _ in lengths})
    rows = _with_place(df, F.col(ip))
    addresses = rows.where(F.col("_f").isin(families)).select("_f", "_a", "_b").distinct()

    wide = {f: [b for own, b in lengths if own == f and b <= BLOCK[f]] for f in families}
    probe = reduce(lambda c, f: c.when(F.col("_f") == f, F.array(*[F.lit(b) for b in wide[f]]).cast("array<int>")), families, F)
    # With a number that is asked for, the distinct addresses above serve here too and are not made again.
    blocks = addresses.groupBy("_f", "_a").agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").withColumn("_l", F.explode(probe))
    own_block = F.when(F.col("_f") == 4, BLOCK[4]).otherwise(BLOCK[6])
    probes = blocks.withColumn("_s", own_block - F.col("_l")).select("_f", F.col("_a").alias("_own"), "_l", _cut("_a", "_s").alias("_p"))
    over = held.where(F.col("_bits") <= block).select("_family", "_bits", F.col("_a").alias("_prefix"), "_labels")
    same = [F.col("_f") == F.col("_family"), F.col("_l") == F.col("_bits"), F.col("_p") == F.col("_prefix")]
    around = probes.join(over, reduce(lambda a, b: a & b, same)).groupBy("_f", F.col("_own").alias("_a")).agg(
        F.max(F.struct("_bits", "_labels")).alias("_most")
    )

    # What holds the whole block comes first, then networks and addresses by place, networks before addresses.
    none = F.lit(None)
    first = around.select("_f", "_a", none.cast("bigint").alias("_b"), F.lit(0).alias("_bits"), F.col("_most._labels").alias("_labels"))
    inside = held.where(F.col("_bits") > block).select(F.col("_family").alias("_f"), "_a", "_b", "_bits", "_labels")
    kind = dict(held.dtypes)["_labels"]
    asked = addresses.select("_f", "_a", "_b", none.cast("int").alias("_bits"), none.cast(kind).alias("_labels"))
    order = Window.partitionBy("_f", "_a").orderBy(F.col("_b").asc_nulls_first(), F.col("_bits").asc_nulls_last())
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    narrow = [(f, b) for f, b in lengths if b > BLOCK[f]]  # a length says the family
    seen = {f"_w{b}": F.last(F.when(F.col("_bits") == b, F.struct("_b", "_labels")), ignorenulls=True).over(order) for b in (0, *[b for _, b in narrow])}
    met = first.unionByName(inside).unionByName(asked).withColumns(seen).where("_bits IS NULL")
    holds = lambda f, b: F.shiftright(F.col(f"_w{b}._b"), BITS[f] - b) == F.shiftright(F.col("_b"), BITS[f] - b)
    found = [F.when(holds(f, b), F.col(f"_w{b}._labels")) for f, b in sorted(narrow, key=lambda x: -x[1])]
    best = met.select("_f", "_a", "_b", F.coalesce(*found, F.col("_w0._labels")).alias("_best")).where("_best IS NOT NULL")
    best = best.select(*[F.col(c).alias(f"_k{c}") for c in ("_f", "_a", "_b")], *[F.col(f"_best.`{c}`").alias(c) for c in labels])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k{c}") for c in ("_f", "_a", "_b")])
    return rows.join(best, on, "left").drop("_f", "_a", "_b", "_k_f", "_k_a", "_k_b")
