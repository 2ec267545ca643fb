"""Cleaning functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetrina import vocab
from vetrina.functions import text as t
from vetrina.functions import values as v
from vetrina.plans.base import OFFERS, PRODUCTS, offers, products, query, table

_NORM = r"nullif(trim(regexp_replace(regexp_replace(replace(lower(strip_accents({0})), ',', ' '), '[^\pL\pN_\s%+./-]', ' ', 'g'), '\s+', ' ', 'g')), '')"


def _norm(x: str) -> str:
    return _NORM.replace("{0}", x)


def _rules_sql(text: str, rules) -> str:
    found = ", ".join("CASE WHEN " + " OR ".join(f"contains(' ' || {text} || ' ', ' {term} ')" for term in terms) + f" THEN '{value}' END" for value, *terms in rules)
    return f"coalesce({found})"


@query("normalize_text", f"SELECT doc_id, {_norm('text')} AS normalized FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", t.normalized_text(F.col("text")).alias("normalized"))


def _clean_sql(x: str) -> str:
    """The search title in SQL: units joined to their numbers, marketing phrases out, ASCII letters and digits."""
    phrases = "|".join(sorted((p.replace("-", r"\-") for p in vocab.MARKETING_PHRASES), key=len, reverse=True))
    joined = rf"regexp_replace({_norm(x)}, '\b(\d+)(?:[.,](\d+))?\s*[- ]?\s*({'|'.join(vocab.UNITS)})\b', '\1' || chr(1) || '\2\3', 'g')"
    points = rf"replace(regexp_replace({joined}, chr(1) || '(\d)', '.\1', 'g'), chr(1), '')"
    return rf"nullif(trim(regexp_replace(regexp_replace(regexp_replace({points}, '\b(?:{phrases})\b', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), '')"


_TITLES = """titles AS (
  SELECT p_partkey, p_name || [' ' || p_size || ' GB, ', ' - ' || p_size || '.5kg ', ' ram' || p_size || ' mah', ' In  Offerta ' , ' novità/Best-Seller ', ' promozione ' || p_size || 'inch'][p_partkey % 6 + 1] || (p_partkey % 9) || ',5 cm - ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' Spedizione Gratuita!' ELSE ' garanzia italiana' END AS title
  FROM part)"""


def _titles(spark, d):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    forms = [F.concat(F.lit(" "), size, F.lit(" GB, ")), F.concat(F.lit(" - "), size, F.lit(".5kg ")), F.concat(F.lit(" ram"), size, F.lit(" mah")), F.lit(" In  Offerta "), F.lit(" novità/Best-Seller "), F.concat(F.lit(" promozione "), size, F.lit("inch"))]
    ending = F.when(F.col("p_size") % 2 == 0, " Spedizione Gratuita!").otherwise(" garanzia italiana")
    title = F.concat("p_name", F.element_at(F.array(*forms), (key % 6 + 1).cast("int")), (key % 9).cast("string"), F.lit(",5 cm - "), "p_type", ending)
    return table(spark, d, "part").select("p_partkey", title.alias("title"))


@query("clean_title", f"WITH {_TITLES} SELECT p_partkey, {_clean_sql('title')} AS clean FROM titles")
def clean_title(spark, d):
    return _titles(spark, d).select("p_partkey", t.clean_title(F.col("title")).alias("clean"))


@query("display_text", r"SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(nfc_normalize(text), '\p{C}', ' ', 'g'), '\s+', ' ', 'g')), '') AS shown FROM documents")
def display_text(spark, d):
    return table(spark, d, "documents").select("doc_id", t.display_text(F.col("text")).alias("shown"))


@query(
    "price_parse",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 5 AS form,
       CASE l_orderkey % 5 WHEN 4 THEN NULL
         WHEN 3 THEN CAST(concat(CAST(floor(l_extendedprice / 1000) AS BIGINT), '.', lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0')) AS DOUBLE)
         ELSE l_extendedprice END AS parsed
FROM lineitem""",
)
def price_parse(spark, d):
    x = table(spark, d, "lineitem").withColumns({"form": F.col("l_orderkey") % 5, "_c": F.col("l_extendedprice").cast("decimal(12,2)")})
    whole, cents = F.floor("_c").cast("long"), F.substring_index(F.col("_c").cast("string"), ".", -1)
    thousands, rest = F.floor(whole / 1000).cast("string"), F.lpad((whole % 1000).cast("string"), 3, "0")
    text = (
        F.when(F.col("form") == 0, F.concat(thousands, F.lit("."), rest, F.lit(","), cents, F.lit(" €")))
        .when(F.col("form") == 1, F.concat(F.lit("EUR "), thousands, F.lit(","), rest, F.lit("."), cents))
        .when(F.col("form") == 2, F.concat(whole.cast("string"), F.lit(","), cents))
        .when(F.col("form") == 3, F.concat(thousands, F.lit(","), rest))
        .otherwise(F.concat(whole.cast("string"), F.lit("-"), cents, F.lit("-,.")))
    )
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "form", v.parsed_price(text).alias("parsed"))


@query(
    "ean_mpn_valid",
    """WITH keys AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN 'AB-' || c_custkey WHEN 2 THEN '-' || c_custkey ELSE c_name END AS mpn,
  CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 13, '0') WHEN 1 THEN c_name ELSE lpad(CAST(c_custkey AS VARCHAR), 7, '1') END AS ean FROM customer)
SELECT c_custkey,
  CASE WHEN length(regexp_replace(ean, '\\D', '', 'g')) IN (8, 12, 13, 14) AND regexp_matches(ean, '[1-9]') THEN regexp_replace(ean, '\\D', '', 'g') END AS ean,
  CASE WHEN lower(mpn) NOT IN ('n/a', 'na', 'null', 'none', '-', '0') AND regexp_full_match(mpn, '[A-Za-z0-9][A-Za-z0-9._/-]{2,79}') THEN mpn END AS mpn FROM keys""",
)
def ean_mpn_valid(spark, d):
    key = F.col("c_custkey")
    mpn = F.when(key % 4 == 0, "n/a").when(key % 4 == 1, F.concat(F.lit("AB-"), key.cast("string"))).when(key % 4 == 2, F.concat(F.lit("-"), key.cast("string"))).otherwise(F.col("c_name"))
    ean = F.when(key % 3 == 0, F.lpad(key.cast("string"), 13, "0")).when(key % 3 == 1, F.col("c_name")).otherwise(F.lpad(key.cast("string"), 7, "1"))
    return table(spark, d, "customer").select("c_custkey", v.valid_ean(ean).alias("ean"), v.valid_mpn(mpn).alias("mpn"))


_MODELS = """texts AS (
  SELECT c_custkey, ['Giacca 1234567 abcdef x' || c_custkey || '-pro nera', '-ab' || c_custkey || '- ' || c_name, 'nuovo ' || c_mktsegment || ' ' || c_name || '/v2x', 'x_' || c_custkey || ' A1' || c_custkey, 'senza modello', 'ZX-' || c_custkey || 'é qq' || c_custkey][c_custkey % 6 + 1] AS title,
         CASE WHEN c_custkey % 5 = 0 THEN 'MPN' || c_custkey END AS mpn
  FROM customer)"""


@query(
    "model_extract",
    f"WITH {_MODELS}, words AS (SELECT *, list_transform(regexp_extract_all(title, '[\\pL\\pN_-]+'), lambda w: trim(w, '-')) AS w FROM texts) "
    "SELECT c_custkey, coalesce(mpn, upper(list_filter(w, lambda x: length(x) >= 6 AND regexp_full_match(x, '[A-Za-z0-9-]+') AND regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]'))[1])) AS model FROM words",
)
def model_extract(spark, d):
    key = F.col("c_custkey").cast("string")
    forms = [F.concat(F.lit("Giacca 1234567 abcdef x"), key, F.lit("-pro nera")), F.concat(F.lit("-ab"), key, F.lit("- "), "c_name"), F.concat(F.lit("nuovo "), "c_mktsegment", F.lit(" "), "c_name", F.lit("/v2x")), F.concat(F.lit("x_"), key, F.lit(" A1"), key), F.lit("senza modello"), F.concat(F.lit("ZX-"), key, F.lit("é qq"), key)]
    title = F.element_at(F.array(*forms), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", v.extracted_model(title, F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("MPN"), key))).alias("model"))


def _size_sql(x: str) -> str:
    """Sizes as a list without repeats, in SQL."""
    raw = rf"replace(regexp_replace({x}, '(\d),(\d)', '\1.\2', 'g'), ',', '/')"
    one = "|".join(w.replace(" ", r"\s+") for w in vocab.SIZE_ONE_ALIASES)
    text = rf"regexp_replace(regexp_replace({_norm(raw)}, '\b(?:{one})\b', 'taglia unica', 'g'), '\b(?:it|eu)\s*', '', 'g')"
    parts = f"list_filter(list_transform(string_split({text}, '/'), lambda y: trim(y)), lambda y: y <> '')"
    return f"(SELECT nullif(array_to_string(list_filter(l, lambda y, i: list_position(l, y) = i), ', '), '') FROM (SELECT {parts} AS l))"


_SIZES = """sizes AS (
  SELECT p_partkey, p_name, p_size, ['One  Size', 'EU ' || p_size || ',5, M', 'IT ' || p_size || ' / 38 / XL /' || p_size, 'S, L, S', ' ', 'TU/uni', 'w' || p_size || ' L34 ; ' || p_size][p_partkey % 7 + 1] AS raw,
         [' - ' || p_size, ' Taglia: XL / ' || p_size, ' ' || p_size || 'xl', ' size m,EU ' || p_size || '.5 blu', ' misura - w' || p_size || 'l32', ' S ' || p_size, ' uk ' || p_size][p_partkey % 7 + 1] AS ending
  FROM part)"""


def _sizes(spark, d):
    n = F.col("p_size").cast("string")
    at = (F.col("p_partkey") % 7 + 1).cast("int")
    raw = [F.lit("One  Size"), F.concat(F.lit("EU "), n, F.lit(",5, M")), F.concat(F.lit("IT "), n, F.lit(" / 38 / XL /"), n), F.lit("S, L, S"), F.lit(" "), F.lit("TU/uni"), F.concat(F.lit("w"), n, F.lit(" L34 ; "), n)]
    ending = [F.concat(F.lit(" - "), n), F.concat(F.lit(" Taglia: XL / "), n), F.concat(F.lit(" "), n, F.lit("xl")), F.concat(F.lit(" size m,EU "), n, F.lit(".5 blu")), F.concat(F.lit(" misura - w"), n, F.lit("l32")), F.concat(F.lit(" S "), n), F.concat(F.lit(" uk "), n)]
    return table(spark, d, "part").select("p_partkey", F.element_at(F.array(*raw), at).alias("raw"), F.concat("p_name", F.element_at(F.array(*ending), at)).alias("title"))


@query("size_normalize", f"WITH {_SIZES} SELECT p_partkey, {_size_sql('raw')} AS size FROM sizes")
def size_normalize(spark, d):
    return _sizes(spark, d).select("p_partkey", t.normalized_size(F.col("raw")).alias("size"))


def _one_size(x: str) -> str:
    """Whether a text is a size, in SQL, by numbers and words instead of one pattern."""
    letters = [*vocab.SIZE_LETTERS, *(f"{n}xl" for n in range(2, vocab.SIZE_LARGEST_XL + 1)), *vocab.SIZE_WORDS]
    number = lambda y: rf"try_cast(regexp_extract({y}, '^(\d+)([.,]\d+)?$', 1) AS INTEGER)"
    plain = f"list_contains({letters}, {x}) OR length(regexp_extract({x}, '^(\\d+)', 1)) = 2 AND {number(x)} BETWEEN {vocab.SIZE_NUMBERS[0]} AND {vocab.SIZE_NUMBERS[1]}"
    regions = " OR ".join(f"starts_with({x}, '{r}') AND {number(f'trim({x}[3:])')} BETWEEN {a} AND {b}" for r, (a, b) in vocab.SIZE_REGIONS.items())
    return rf"({plain} OR {regions} OR regexp_full_match({x}, 'w\s*\d\d\s*l\s*\d\d'))"


_LABELLED = r"lower(regexp_extract(title, '(?i)(?:taglia|size|misura)\s*[:\-]?\s*(.*)$', 1))"


@query(
    "size_extract",
    f"""WITH {_SIZES}, titles AS (SELECT p_partkey, p_name || ending AS title, p_partkey % 7 AS k FROM sizes),
tokens AS (SELECT *, {_LABELLED} AS tail, lower(string_split(title, ' ')[-1]) AS last, lower(array_to_string(string_split(title, ' ')[-2:], ' ')) AS last_two FROM titles),
labelled AS (SELECT *, list_transform(string_split(replace(replace(tail, ',', '/'), ' blu', ''), '/'), lambda y: trim(y)) AS parts FROM tokens),
picked AS (SELECT *, CASE WHEN tail <> '' THEN array_to_string(CASE WHEN {_one_size("parts[1]")} THEN CASE WHEN len(parts) > 1 AND {_one_size("parts[2]")} THEN parts[:2] ELSE parts[:1] END END, '/')
    WHEN {_one_size("last_two")} THEN last_two WHEN {_one_size("last")} THEN last END AS found FROM labelled)
SELECT p_partkey, {_size_sql("found")} AS size FROM picked""",
)
def size_extract(spark, d):
    return _sizes(spark, d).select("p_partkey", t.extracted_size(F.col("title")).alias("size"))


@query("size_strip", "WITH endings AS (SELECT p_partkey, p_name, p_partkey % 3 AS k, 30 + p_size % 30 AS n FROM part) SELECT p_partkey, CASE k WHEN 2 THEN p_name || ' ' || n || ' x' ELSE p_name END AS rest FROM endings")
def size_strip(spark, d):
    """Sizes at the end, labelled ones, and numbers inside, which stay."""
    k, n = F.col("p_partkey") % 3, (30 + F.col("p_size") % 30).cast("string")
    title = F.concat("p_name", F.when(k == 0, F.concat(F.lit(" - "), n)).when(k == 1, F.concat(F.lit(" Taglia: XL/"), n)).otherwise(F.concat(F.lit(" "), n, F.lit(" x"))))
    return table(spark, d, "part").select("p_partkey", t.without_size(title).alias("rest"))


@query(
    "category_rules",
    f"WITH {PRODUCTS}, texts AS (SELECT product_id, CASE product_id % 6 WHEN 0 THEN 'felpa ' WHEN 1 THEN 'air jordan ' WHEN 2 THEN 'borsa in pelle ' WHEN 3 THEN 'giacca accessories ' WHEN 4 THEN 'cardigan ' ELSE '' END || title AS s FROM products) "
    + f"SELECT product_id, {_rules_sql('s', vocab.SUBCATEGORY_RULES)} AS subcategory, {_rules_sql('s', vocab.CATEGORY_RULES)} AS category FROM texts",
)
def category_rules(spark, d):
    k = F.col("product_id") % 6
    text = F.concat(F.when(k == 0, "felpa ").when(k == 1, "air jordan ").when(k == 2, "borsa in pelle ").when(k == 3, "giacca accessories ").when(k == 4, "cardigan ").otherwise(""), F.col("title"))
    return products(spark, d).select("product_id", t.first_rule(text, vocab.SUBCATEGORY_RULES).alias("subcategory"), t.first_rule(text, vocab.CATEGORY_RULES).alias("category"))


@query("attribute_rules", f"SELECT p_partkey, {_rules_sql('lower(p_name)', vocab.COLOR_RULES)} AS color, coalesce({_rules_sql('lower(p_name)', vocab.COLOR_RULES)}, lower(p_name)) AS color_or_text, {_rules_sql(chr(39) + 'women' + chr(39), vocab.GENDER_RULES)} AS gender FROM part")
def attribute_rules(spark, d):
    return table(spark, d, "part").select("p_partkey", t.known_value(F.col("p_name"), vocab.COLOR_RULES).alias("color"), t.canonical_value(F.col("p_name"), vocab.COLOR_RULES).alias("color_or_text"), t.known_value(F.lit("WOMEN"), vocab.GENDER_RULES).alias("gender"))


@query("display_title", "SELECT p_partkey, CASE WHEN string_split(p_name, ' ')[1] IN ('red', 'blue') THEN string_split(p_name, ' ')[2] ELSE p_name END AS shown FROM part")
def display_title(spark, d):
    brand = F.lower("p_brand")
    title = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" in offerta cotone uomo in pelle e - 42"))
    return table(spark, d, "part").select("p_partkey", t.display_title(title, brand).alias("shown"))


_ISSUE_TERMS = sorted({x for rules in (vocab.COLOR_RULES, vocab.MATERIAL_RULES, vocab.GENDER_RULES, vocab.AGE_GROUP_RULES) for _, *terms in rules for x in terms if len(x) > 2} | set(vocab.TITLE_ATTRIBUTE_WORDS))


@query(
    "title_issues",
    f"""WITH rows_ AS (SELECT p_partkey, p_name || [' con', ' mesh', ' and', ' Uomo', ' multi colour', ' x-in', '.', ' taupés'][p_partkey % 8 + 1] AS raw FROM part UNION ALL SELECT -s_suppkey, ' ' FROM supplier),
texts AS (SELECT p_partkey, coalesce({_norm("raw")}, '') AS t FROM rows_)
SELECT p_partkey, CASE WHEN t = '' THEN 'titolo_vuoto' ELSE concat_ws(' | ', CASE WHEN list_contains({vocab.TITLE_TRAILING_WORDS}, string_split(t, ' ')[-1]) THEN 'connettivo_finale' END,
  CASE WHEN {" OR ".join(f"contains(' ' || t || ' ', ' {x} ')" for x in _ISSUE_TERMS)} THEN 'attributo_nel_titolo' END,
  CASE WHEN regexp_matches(t, '\\b(?:{"|".join(vocab.TITLE_LINKS)})$') THEN 'preposizione_finale' END) END AS issues FROM texts""",
)
def title_issues(spark, d):
    forms = F.array(*map(F.lit, [" con", " mesh", " and", " Uomo", " multi colour", " x-in", ".", " taupés"]))
    titles = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.element_at(forms, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("raw"))
    empty = table(spark, d, "supplier").select((-F.col("s_suppkey")).alias("p_partkey"), F.lit(" ").alias("raw"))
    return titles.unionByName(empty).select("p_partkey", F.concat_ws(" | ", t.title_issues(F.col("raw"))).alias("issues"))


@query("family_title", "SELECT p_partkey, trim(regexp_replace(CASE WHEN p_size BETWEEN 30 AND 50 THEN p_name ELSE p_name || ' ' || p_size END, '\\s+', ' ', 'g')) AS family FROM part".replace("BETWEEN 30 AND 50", "BETWEEN 30 AND 59"))
def family_title(spark, d):
    return table(spark, d, "part").select("p_partkey", t.family_title(F.concat("p_name", F.lit(" nero xl "), F.col("p_size").cast("string"))).alias("family"))


@query("discount_pct", f"WITH {OFFERS} SELECT id, CAST(price AS DOUBLE) AS price, CAST(sale_price AS DOUBLE) AS sale_price, CAST(round((price - sale_price) / price * 100, 2) AS DOUBLE) AS percent, CAST(round((1 - CAST(sale_price AS DOUBLE) / CAST(price AS DOUBLE)) * 100, 0) AS INTEGER) AS card FROM offers WHERE sale_price IS NOT NULL")
def discount_pct(spark, d):
    price, sale = v.price_pair(F.col("price"), F.col("sale_price"))
    rows = offers(spark, d).withColumns({"_p": price, "_s": sale}).where("_s is not null")
    return rows.select("id", F.col("_p").cast("double").alias("price"), F.col("_s").cast("double").alias("sale_price"), v.discount_percent(F.col("_p").cast("double"), F.col("_s").cast("double")).alias("percent"), v.card_discount(F.col("_p").cast("double"), F.col("_s").cast("double")).alias("card"))


@query("availability_flag", f"WITH {OFFERS} SELECT id, CASE flag WHEN 'A' THEN TRUE WHEN 'N' THEN status = 'O' ELSE FALSE END AS available FROM offers")
def availability_flag(spark, d):
    rows = offers(spark, d).select("id", F.when(F.col("flag") == "A", "In_Stock").otherwise("").alias("availability"), F.when(F.col("flag") == "N", F.when(F.col("status") == "O", "YES").otherwise("Sold Out")).alias("in_stock"), F.when(F.col("flag") == "R", F.when(F.col("status") == "O", "0").otherwise(" ")).alias("stock_status"))
    return rows.select("id", v.is_available(rows.columns).alias("available"))


@query("semantic_hash", "SELECT doc_id, sha256(concat_ws('|', '2026-10-05', nullif(lang, ''), CASE WHEN doc_id % 3 <> 0 THEN source END, nullif(text, ''))) AS content_hash FROM documents")
def semantic_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", v.content_hash(F.col("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise(""), F.col("text")).alias("content_hash"))


@query("operational_hash", f"WITH {OFFERS} SELECT id, sha256(concat_ws('|', CAST(price AS VARCHAR), coalesce(CAST(sale_price AS VARCHAR), ''), CAST(quantity AS VARCHAR), source_product_id, '')) AS operational_hash FROM offers")
def operational_hash(spark, d):
    return offers(spark, d).select("id", v.operational_hash(F.col("price"), F.col("sale_price"), F.col("quantity"), F.col("source_product_id"), F.lit(None).cast("string")).alias("operational_hash"))


@query("synthetic_ids", "SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT) AS synthetic FROM documents")
def synthetic_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", v.synthetic_id(F.col("text")).alias("synthetic"))


@query(
    "price_labels",
    f"WITH {OFFERS} SELECT id, CASE quantity % 4 WHEN 0 THEN '€' || price WHEN 1 THEN '£' || price WHEN 2 THEN price || ' CHF' ELSE '€' || price END AS label, CASE WHEN quantity % 5 = 0 THEN 'Taglia non specificata' ELSE 'Taglie ' || quantity END AS size_label FROM offers",
)
def price_labels(spark, d):
    k = F.col("quantity") % 4
    code = F.when(k == 0, "eur").when(k == 1, "GBP").when(k == 2, "chf").otherwise("")
    size = F.when(F.col("quantity") % 5 == 0, " 0 ").otherwise(F.col("quantity").cast("string"))
    return offers(spark, d).select("id", v.formatted_price(F.col("price"), code).alias("label"), v.size_label(size, F.when(F.col("quantity") % 5 == 0, "Cappello nero").otherwise("Giacca")).alias("size_label"))


@query("catalog_dates", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime((date_trunc('milliseconds', ts) - INTERVAL (CASE WHEN event_id % 3 = 1 THEN 2 ELSE 0 END) HOUR + INTERVAL 1 HOUR), '%d/%m/%Y %H:%M') END AS label FROM events")
def catalog_dates(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table(spark, d, "events").select("event_id", v.catalog_date(F.concat(text, F.when(F.col("event_id") % 3 == 1, "+02").when(F.col("event_id") % 3 == 2, "Z").otherwise(""))).alias("label"))


@query("quota_messages", "SELECT event_id, event_id % 2 = 0 OR event_id % 3 = 0 AS is_quota, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 60 + 1.5 ELSE 30 END AS DOUBLE) AS wait_seconds FROM events")
def quota_messages(spark, d):
    key = F.col("event_id")
    text = F.when(key % 3 == 0, F.concat(F.lit("Resource_Exhausted: please RETRY in "), (key % 60).cast("string"), F.lit(".5s"))).when(key % 2 == 0, F.lit("HTTP 429")).otherwise(F.lit("HTTP 500"))
    return table(spark, d, "events").select("event_id", v.is_quota_error(text).alias("is_quota"), v.retry_seconds(text).alias("wait_seconds"))


@query(
    "color_conflict",
    """WITH colors AS (SELECT vec_id, ['nero','bianco','rosso','blu','multicolore'][vec_id % 5 + 1] AS feed, ['nero','blu','rosso'][label % 3 + 1] AS seen FROM embeddings)
SELECT vec_id, feed <> 'multicolore' AND feed <> seen AS conflict FROM colors""",
)
def color_conflict(spark, d):
    feed = F.element_at(F.array(*map(F.lit, ["Black", "white/", "RED", "blue", "multicolore"])), (F.col("vec_id") % 5 + 1).cast("int"))
    seen = F.element_at(F.array(*map(F.lit, ["nero", "blu", "red-unknown"])), (F.col("label") % 3 + 1).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", t.color_conflict(t.visual_colors(feed), t.visual_colors(seen)).alias("conflict"))
