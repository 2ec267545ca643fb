"""How the driver tables play the catalogue's parts, in Spark and in SQL, and the registry of queries.

An order line is an offer: its supplier is the merchant, (order, line) the merchant's id of it, its part the product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.functions.values import synthetic_id

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def offers(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as offers; ids are digests of what makes a line unique."""
    x = table(spark, d, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    sale = F.round(price * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(12,2)")
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), price.cast("string"))
    return x.select(
        synthetic_id(text).alias("id"),
        F.col("l_suppkey").alias("advertiser_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("source_product_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        price.alias("price"),
        F.when(F.col("l_discount") > 0, sale).alias("sale_price"),
        (F.col("l_returnflag") != "R").alias("available"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_shipdate").alias("seen_at"),
    )


OFFERS = """offers AS (
  SELECT CAST('0x' || substr(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(12,2)))), 1, 15) AS BIGINT) AS id,
         l_suppkey AS advertiser_id, concat_ws('-', l_orderkey, l_linenumber) AS source_product_id, l_partkey AS product_id,
         l_orderkey AS order_id, l_linenumber AS line, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CASE WHEN l_discount > 0 THEN CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(12,2)) END AS sale_price,
         l_returnflag <> 'R' AS available, l_returnflag AS flag, l_linestatus AS status,
         CAST(l_quantity AS INTEGER) AS quantity, l_shipdate AS seen_at
  FROM lineitem)"""


def products(spark: SparkSession, d: str) -> DataFrame:
    """Parts as products, with attributes from their names and numbers; some are left empty."""
    x = table(spark, d, "part")
    kind = F.substring_index("p_name", " ", -1)
    return x.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lower("p_type"), F.lit(" "), F.col("p_name"))).alias("description"),
        F.lower("p_brand").alias("brand"),
        F.lower("p_type").alias("product_type"),
        kind.alias("sottocategoria"),
        F.when(F.col("p_size") % 3 == 0, "uomo").when(F.col("p_size") % 3 == 1, "donna").alias("gender"),
        F.lit("adulto").alias("age_group"),
        F.when(F.col("p_partkey") % 7 != 0, F.substring_index("p_name", " ", 1)).alias("color"),
        F.when(F.col("p_partkey") % 4 == 0, "cotone").when(F.col("p_partkey") % 4 == 1, "lana").when(F.col("p_partkey") % 4 == 2, "pelle").alias("material"),
        F.concat_ws(", ", F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") + 1).cast("string"), F.lit(".5")))).alias("size"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("list_price"),
    )


PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, p_name AS title,
         CASE WHEN p_partkey % 5 <> 0 THEN lower(p_type) || ' ' || p_name END AS description,
         lower(p_brand) AS brand, lower(p_type) AS product_type, string_split(p_name, ' ')[-1] AS sottocategoria,
         CASE p_size % 3 WHEN 0 THEN 'uomo' WHEN 1 THEN 'donna' END AS gender, 'adulto' AS age_group,
         CASE WHEN p_partkey % 7 <> 0 THEN string_split(p_name, ' ')[1] END AS color,
         CASE p_partkey % 4 WHEN 0 THEN 'cotone' WHEN 1 THEN 'lana' WHEN 2 THEN 'pelle' END AS material,
         concat_ws(', ', p_size, CASE WHEN p_size % 2 = 0 THEN (p_size + 1) || '.5' END) AS size,
         CAST(p_retailprice AS DECIMAL(12,2)) AS list_price
  FROM part)"""


def view(spark: SparkSession, d: str) -> DataFrame:
    """The search view: one row per offer."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("advertiser_id"), F.lower("s_name").alias("merchant"))
    joined = offers(spark, d).join(products(spark, d), "product_id").join(s, "advertiser_id")
    return joined.withColumns({"availability": F.when(F.col("available"), 1).otherwise(0), "condizione": F.lit("nuovo"), "currency": F.lit("EUR"), "source": F.lit("awin")})


VIEW = f"""{OFFERS}, {PRODUCTS}, view_ AS (
  SELECT o.*, p.* EXCLUDE (product_id), lower(s.s_name) AS merchant, CASE WHEN available THEN 1 ELSE 0 END AS availability,
         'nuovo' AS condizione, 'EUR' AS currency, 'awin' AS source
  FROM offers o JOIN products p USING (product_id) JOIN supplier s ON s.s_suppkey = o.advertiser_id)"""


def product_view(spark: SparkSession, d: str) -> DataFrame:
    """The search view over products alone, for filters that do not depend on offers."""
    return products(spark, d).withColumns({"id": F.col("product_id"), "price": F.col("list_price"), "sale_price": F.when(F.col("product_id") % 3 == 0, F.col("list_price") - 50), "availability": F.when(F.col("product_id") % 11 != 0, 1).otherwise(0), "condizione": F.lit("nuovo"), "merchant": F.concat(F.lit("shop "), (F.col("product_id") % 9).cast("string"))})


PRODUCT_VIEW = f"""{PRODUCTS}, pview AS (
  SELECT *, product_id AS id, list_price AS price, CASE WHEN product_id % 3 = 0 THEN list_price - 50 END AS sale_price,
         CASE WHEN product_id % 11 <> 0 THEN 1 ELSE 0 END AS availability, 'nuovo' AS condizione, 'shop ' || (product_id % 9) AS merchant
  FROM products)"""


def stored_offers(spark: SparkSession, d: str) -> DataFrame:
    """The stored snapshot: what was shipped before its date, one row per (merchant, source id), some with an EAN."""
    from vetrina.functions.values import content_hash, operational_hash
    from vetrina.operators.identity import first_by

    x = first_by(offers(spark, d).where(F.col("seen_at") < F.expr(SNAPSHOT[1])), ["advertiser_id", "source_product_id"], "id")
    return x.select("id", "advertiser_id", "source_product_id", _ean().alias("ean"), "price", "sale_price", "available", content_hash((F.col("product_id") % 50).cast("string")).alias("content_hash"), operational_hash(F.col("price"), F.col("sale_price"), F.col("quantity")).alias("operational_hash"))


def incoming_offers(spark: SparkSession, d: str) -> DataFrame:
    """The next feed: what was shipped from an earlier date on, some with other content, other prices, or without id."""
    from vetrina.functions.values import content_hash, operational_hash
    from vetrina.operators.identity import first_by

    x = first_by(offers(spark, d).where(F.col("seen_at") >= F.expr(SNAPSHOT[0])), ["advertiser_id", "source_product_id"], "id")
    price = F.when(F.col("quantity") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(12,2)")
    content = F.when(F.col("quantity") % 11 == 0, F.lit("changed")).otherwise((F.col("product_id") % 50).cast("string"))
    return x.select("advertiser_id", F.when(F.col("line") == 1, F.concat(F.lit("new-"), "source_product_id")).otherwise(F.col("source_product_id")).alias("source_product_id"), _ean().alias("ean"), price.alias("price"), "sale_price", content_hash(content).alias("content_hash"), operational_hash(price, F.col("sale_price"), F.col("quantity")).alias("operational_hash"))


def _ean():
    return F.when(F.col("line") == 1, F.lpad((F.col("order_id") * 10 + F.col("line")).cast("string"), 13, "0"))


#: From when the next feed has lines, and until when the stored snapshot has them.
SNAPSHOT = ("timestamp '1996-06-01 00:00:00'", "timestamp '2000-06-01 00:00:00'")

STORED = f"""{OFFERS}, stored AS (
  SELECT id, advertiser_id, source_product_id, CASE WHEN line = 1 THEN lpad(CAST(order_id * 10 + line AS VARCHAR), 13, '0') END AS ean, price, sale_price, available,
         sha256(concat_ws('|', '2026-10-05', CAST(product_id % 50 AS VARCHAR))) AS content_hash,
         sha256(concat_ws('|', CAST(price AS VARCHAR), coalesce(CAST(sale_price AS VARCHAR), ''), CAST(quantity AS VARCHAR))) AS operational_hash
  FROM (SELECT * FROM offers WHERE seen_at < {SNAPSHOT[1]} QUALIFY row_number() OVER (PARTITION BY advertiser_id, source_product_id ORDER BY id) = 1)),
incoming_raw AS (
  SELECT *, CAST(CASE WHEN quantity % 7 = 0 THEN price + 1 ELSE price END AS DECIMAL(12,2)) AS new_price,
         CASE WHEN quantity % 11 = 0 THEN 'changed' ELSE CAST(product_id % 50 AS VARCHAR) END AS content
  FROM (SELECT * FROM offers WHERE seen_at >= {SNAPSHOT[0]} QUALIFY row_number() OVER (PARTITION BY advertiser_id, source_product_id ORDER BY id) = 1)),
incoming AS (
  SELECT advertiser_id, CASE WHEN line = 1 THEN 'new-' || source_product_id ELSE source_product_id END AS source_product_id,
         CASE WHEN line = 1 THEN lpad(CAST(order_id * 10 + line AS VARCHAR), 13, '0') END AS ean, new_price AS price, sale_price,
         sha256(concat_ws('|', '2026-10-05', content)) AS content_hash,
         sha256(concat_ws('|', CAST(new_price AS VARCHAR), coalesce(CAST(sale_price AS VARCHAR), ''), CAST(quantity AS VARCHAR))) AS operational_hash
  FROM incoming_raw),
by_ean AS (SELECT advertiser_id, ean, min(id) AS id FROM stored WHERE ean IS NOT NULL GROUP BY ALL),
by_source AS (SELECT advertiser_id, source_product_id, min(id) AS id FROM stored GROUP BY ALL),
matched AS (
  SELECT i.*, coalesce(e.id, s.id) AS stored_id
  FROM incoming i LEFT JOIN by_ean e USING (advertiser_id, ean) LEFT JOIN by_source s USING (advertiser_id, source_product_id)),
classified AS (
  SELECT m.*, CASE WHEN t.id IS NULL THEN 'new' WHEN t.content_hash IS DISTINCT FROM m.content_hash THEN 'content' WHEN NOT t.available THEN 'reactivated'
                   WHEN t.operational_hash IS DISTINCT FROM m.operational_hash THEN 'updated' ELSE 'unchanged' END AS kind
  FROM matched m LEFT JOIN stored t ON t.id = m.stored_id)"""
