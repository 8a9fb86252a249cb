"""A reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows get numbers 0..N-1 from their content alone: a hash spreads them over `BUCKETS` buckets, the
buckets' counts are summed up (one row per bucket, so a bounded table), and inside a bucket rows
are counted in the order of their keys. A generalised Feistel network then permutes 0..N-1: its
domain a*b is the smallest near-square product that holds N, and numbers that fall outside are
walked along their cycle until they are inside again. Shard and slot follow from the permuted
number, and `permuted` computes them for any row number without Spark.

Only DataFrame functions are used. Identical rows are counted once and expanded after numbering.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blamesplit.llm.staging import written

BUCKETS = 8192
ROUNDS = 6
#: A cycle can leave the range at most a times, and each further step does so with chance 1/sqrt(N).
WALKS = 40
PRIME = 2**31 - 1
CHUNK = 65_536


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two constants below PRIME for each round."""
    found = []
    for j in range(ROUNDS):
        digest = hashlib.sha256(f"{seed}:{j}".encode()).digest()
        found.append((int.from_bytes(digest[:4]) % PRIME, int.from_bytes(digest[4:8]) % PRIME))
    return found


def sides(total: int) -> tuple[int, int]:
    """The factors a and b of the domain, a = ceil(sqrt(total)) and b = ceil(total / a)."""
    a = max(1, round(total**0.5))
    while a * a < total:
        a += 1
    while a > 1 and (a - 1) * (a - 1) >= total:
        a -= 1
    return a, max(1, -(-total // a))


def mixed(r: int, keys: tuple[int, int]) -> int:
    t = (r + keys[0]) % PRIME
    t = (t * t + keys[1]) % PRIME
    return (t * t + r) % PRIME


def permuted(number: int, total: int, seed: int) -> int:
    """Where row `number` of `total` goes; shard = this % shards, slot = this // shards."""
    a, b = sides(total)
    while True:
        left, right = number % a, number // a
        for j, keys in enumerate(round_keys(seed)):
            left, right = right, (left + mixed(right, keys)) % (b if j % 2 else a)
        number = a * right + left
        if number < total:
            return number


def original(place: int, total: int, seed: int) -> int:
    """The row number that `permuted` sends to `place`."""
    a, b = sides(total)
    while True:
        left, right = place % a, place // a
        for j, keys in reversed(list(enumerate(round_keys(seed)))):
            n = b if j % 2 else a
            left, right = (right - mixed(left, keys)) % n, left
        place = a * right + left
        if place < total:
            return place


def _square(c: Column, plus: Column) -> Column:
    return (c * c + plus) % F.lit(PRIME)


def _div(x: Column, by: Column) -> Column:
    """Integer division; `/` would go through doubles."""
    return F.call_function("div", x, by)


def _network(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network, as a fold of its rounds over a (left, right) pair."""
    keys = F.array(
        *(
            F.struct(F.lit(c).cast("long").alias("c"), F.lit(k).cast("long").alias("k"), F.lit(j % 2 == 1).alias("odd"))
            for j, (c, k) in enumerate(round_keys(seed))
        )
    )

    def step(s: Column, r: Column) -> Column:
        right = s["right"]
        f = _square(_square((right + r["c"]) % F.lit(PRIME), r["k"]), right)
        return F.struct(right.alias("left"), ((s["left"] + f) % F.when(r["odd"], b).otherwise(a)).alias("right"))

    start = F.struct((x % a).alias("left"), _div(x, a).alias("right"))
    return F.aggregate(keys, start, step, lambda s: s["right"] * a + s["left"])


def feistel(df: DataFrame, seed: int) -> DataFrame:
    """`df` (row_number, total, ...) with `place`, the permuted row number.

    Most numbers need one pass; the others walk on. Fails rather than return a wrong number.
    """
    total, a, b = F.col("total"), F.col("__a"), F.col("__b")
    root = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    root = F.when((root - 1) * (root - 1) >= total, root - 1).when(root * root < total, root + 1).otherwise(root)
    df = df.withColumn("__a", root).withColumn("__b", _div(total + a - 1, a))
    df = df.withColumn("__once", _network(F.col("row_number"), a, b, seed))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        F.col("__once"),
        lambda y, _: F.when(y < total, y).otherwise(_network(y, a, b, seed)),
    )
    df = df.withColumn("__walked", F.when(F.col("__once") < total, F.col("__once")).otherwise(walk))
    too_long = F.raise_error(F.lit("a cycle of the permutation is too long")).cast("long")
    place = F.when(F.col("__walked") < total, F.col("__walked")).otherwise(too_long)
    return df.withColumn("place", place).drop("__a", "__b", "__once", "__walked")


def numbered(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """`df`'s key columns with `row_number` (from 0, gapless, from content alone) and `total`.

    Repeated rows get consecutive numbers. Null keys count as values and sort first.
    """
    counted = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    counted = written(counted.withColumn("__bucket", _bucket(keys, buckets)))  # texts are read once
    inside = Window.partitionBy("__bucket").orderBy(*(F.col(k).asc_nulls_first() for k in keys))
    before = F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = counted.withColumn("__before", F.coalesce(before, F.lit(0)))
    sums = counted.groupBy("__bucket").agg(F.sum("__n").alias("__rows"))
    upto = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.select(
        "__bucket",
        (F.sum("__rows").over(upto) - F.col("__rows")).alias("__start"),
        F.sum("__rows").over(Window.partitionBy()).alias("total"),
    )
    placed = rows.join(F.broadcast(starts), "__bucket")  # at most `buckets` rows
    # a row repeated more than CHUNK times is dealt over tasks before its copies are written out
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("__n") - 1, F.lit(CHUNK))))
    few = placed.where(F.col("__n") <= CHUNK).withColumn("__chunk", F.lit(0).cast("long"))
    many = placed.where(F.col("__n") > CHUNK).withColumn("__chunk", chunks)
    placed = few.unionByName(many.repartition("__bucket", "__before", "__chunk"))
    last = F.least(F.lit(CHUNK - 1), F.col("__n") - 1 - F.col("__chunk") * CHUNK)
    placed = placed.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    number = F.col("__start") + F.col("__before") + F.col("__chunk") * CHUNK + F.col("__copy")
    return placed.select(*keys, number.alias("row_number"), "total")


def _bucket(keys: list[str], buckets: int) -> Column:
    """A bucket from integer keys in plain arithmetic, so that SQL engines agree on it."""

    def add(h: Column, k: str) -> Column:
        return _square(h, F.coalesce(F.pmod(F.col(k).cast("long"), F.lit(PRIME)), F.lit(PRIME - 1)))

    h = reduce(add, keys, F.lit(1).cast("long"))
    return _square(_square(h, F.lit(7)), F.lit(11)) % buckets


def shuffle_into_shards(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 40, seed: int = 7) -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, row_number, shard, slot).

    Shards' row counts differ by one at most, and slots run from 0 without gaps. `size` is the
    UTF-8 bytes of the text plus 16. A null text has size 16 and no CRC; a null id is a value of
    its own; repeated rows get places of their own; an empty table gives no rows. Other columns of
    `df` are not read.
    """
    narrow = df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(F.col(text), "UTF-8")).alias("text_crc32"),
    )
    rows = numbered(narrow, ["doc_id", "size", "text_crc32"])
    rows = feistel(rows, seed)
    return rows.select(
        "doc_id", "size", "text_crc32", "row_number",
        (F.col("place") % shards).cast("int").alias("shard"),
        _div(F.col("place"), F.lit(shards)).alias("slot"),
    )


def _rounds_sql(source: str, x: str, seed: int) -> str:
    """`source` with `y`, the number that one pass of the network makes of `x`."""
    sql = f"SELECT *, {x} % a AS l0, {x} // a AS r0 FROM ({source})"
    for j, (c, k) in enumerate(round_keys(seed)):
        sql = f"SELECT *, (r{j} + {c}) % {PRIME} AS t FROM ({sql})"
        sql = f"SELECT *, (t * t + {k}) % {PRIME} AS u FROM ({sql})"
        right = f"(l{j} + (u * u + r{j}) % {PRIME}) % {'b' if j % 2 else 'a'}"
        sql = f"SELECT * EXCLUDE (t, u, l{j}, r{j}), r{j} AS l{j + 1}, {right} AS r{j + 1} FROM ({sql})"
    n = ROUNDS
    return f"SELECT * EXCLUDE (l{n}, r{n}), a * r{n} + l{n} AS y FROM ({sql})"


def oracle_sql(shards: int = 40, seed: int = 7) -> str:
    """The query in SQL; CRC-32 is worked out byte by byte from its table."""
    hashed = "SELECT *, CAST(1 AS BIGINT) AS h0 FROM docs"
    for i, key in enumerate(("doc_id", "size", "text_crc32")):
        plus = f"coalesce((({key} % {PRIME}) + {PRIME}) % {PRIME}, {PRIME - 1})"
        hashed = f"SELECT *, (h{i} * h{i} + {plus}) % {PRIME} AS h{i + 1} FROM ({hashed})"
    hashed = f"SELECT *, (h3 * h3 + 7) % {PRIME} AS h4 FROM ({hashed})"
    hashed = f"SELECT doc_id, size, text_crc32, (h4 * h4 + 11) % {PRIME} % {BUCKETS} AS bucket FROM ({hashed})"
    return f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END)) AS tab),
  spelled AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'),
    lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
  docs AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size,
    xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
      lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32 FROM spelled, tab),
  placed AS (SELECT doc_id, size, text_crc32, count(*) OVER () AS total, row_number() OVER (
    ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS row_number FROM ({hashed})),
  sided AS (SELECT *, (total + a - 1) // a AS b FROM (SELECT *, CAST(ceil(sqrt(total)) AS BIGINT) AS a FROM placed)),
  walk AS (
    {_rounds_sql("SELECT * FROM sided", "row_number", seed)}
    UNION ALL {_rounds_sql("SELECT * EXCLUDE (y), y AS x FROM walk WHERE y >= total", "x", seed).replace("SELECT * EXCLUDE (l6", "SELECT * EXCLUDE (x, l6", 1)})
  SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % {shards} AS INTEGER) AS shard, y // {shards} AS slot,
    CAST(NULL AS INTEGER) AS grown_shard, row_number FROM walk WHERE y < total"""
