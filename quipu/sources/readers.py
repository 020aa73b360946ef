"""Readers: typed CSV, JSON documents, XLSX, RSS, sitemaps, JSON-LD products, store search replies, pasted lists, SQL inserts."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.functions.text import amount, without_tags


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header into declared types; a malformed row ends the load; empty strings are null, a byte-order mark is skipped by Spark."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("dateFormat", "yyyy-MM-dd").option("nullValue", "").csv(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


MAIN, LINKS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _elements(part: IO[bytes], name: str) -> Iterator[ET.Element]:
    """Elements of that name as they close; each is forgotten once it was used."""
    for _, element in ET.iterparse(part):
        if element.tag == MAIN + name:
            yield element
            element.clear()


def _strings(element: ET.Element) -> str:
    return "".join(t.text or "" for t in element.iter(MAIN + "t"))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the worksheets in the workbook's order; without a workbook part all worksheet parts, named after their files."""
    names = book.namelist()
    if "xl/workbook.xml" not in names:
        return [(n.rpartition("/")[2].removesuffix(".xml"), n) for n in sorted(names) if n.startswith("xl/worksheets/") and n.endswith(".xml")]
    with book.open("xl/_rels/workbook.xml.rels") as part:
        targets = {e.get("Id"): e.get("Target", "") for _, e in ET.iterparse(part) if e.get("Id")}
    with book.open("xl/workbook.xml") as part:
        named = [(e.get("name", ""), targets[e.get(LINKS + "id")]) for e in _elements(part, "sheet")]
    return [(name, target.lstrip("/") if target.startswith("/") else f"xl/{target}") for name, target in named]


def column_number(reference: str) -> int:
    """`A1` is 1, `AB7` is 28: letters are digits to the base 26."""
    return reduce(lambda n, letter: 26 * n + ord(letter) - 64, reference.rstrip("0123456789"), 0)


def workbook_rows(data: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of one or all sheets, read as events; cells that are left out are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                shared = [_strings(e) for e in _elements(part, "si")]
        meaning = {"s": lambda c: shared[int(c.findtext(MAIN + "v"))], "inlineStr": _strings}
        for name, source in _sheets(book):
            if sheet not in (None, name):
                continue
            with book.open(source) as part:
                for place, row in enumerate(_elements(part, "row"), 1):
                    filled = {column_number(c.get("r", "A")): meaning.get(c.get("t", ""), lambda c: c.findtext(MAIN + "v"))(c) for c in row.findall(MAIN + "c")}
                    yield name, int(row.get("r", place)), [filled.get(n) for n in range(1, max(filled, default=0) + 1)]


def xlsx_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, row, cells) of each workbook's sheets, or of the named one; a task reads a workbook at a time, 1000 rows at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, data in zip(frame["path"], frame["content"], strict=True):
                rows = workbook_rows(bytes(data), sheet)
                while part := list(islice(rows, 1000)):
                    yield pd.DataFrame([(p, *r) for r in part], columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def _tag(block: Column, name: str) -> Column:
    inner = F.regexp_extract(block, rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1)
    return F.nullif(F.trim(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit(""))


def rss_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per item of each feed: link, title, summary, author, category, published (text); other columns of feeds stay."""
    blocks = feeds.withColumn("_b", F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))))
    b = F.col("_b")
    fields = [_tag(b, "link").alias("link"), without_tags(_tag(b, "title")).alias("title"), without_tags(_tag(b, "description")).alias("summary"), F.coalesce(_tag(b, "dc:creator"), _tag(b, "author")).alias("author"), _tag(b, "category").alias("category"), _tag(b, "pubDate").alias("published")]
    return blocks.select(*[c for c in feeds.columns if c != xml], *fields)


def post_entries(replies: DataFrame, body: str = "body") -> DataFrame:
    """Posts of a blog's JSON reply."""
    post = "array<struct<link:string,date_gmt:string,title:struct<rendered:string>,excerpt:struct<rendered:string>>>"
    rows = replies.withColumn("_p", F.explode(F.from_json(body, post)))
    return rows.select(*[c for c in replies.columns if c != body], "_p.link", without_tags(F.col("_p.title.rendered")).alias("title"), without_tags(F.col("_p.excerpt.rendered")).alias("summary"), F.col("_p.date_gmt").alias("published"))


def sitemap_urls(maps: DataFrame, pattern: str, xml: str = "xml") -> DataFrame:
    """Different locations that fit the pattern."""
    return maps.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).filter(F.col("url").rlike(pattern)).distinct()


_OFFER = "struct<price:string,priceCurrency:string,availability:string>"
_PRODUCT = f"`@type`:string,name:string,sku:string,gtin13:string,brand:struct<name:string>,offers:{_OFFER}"


def json_ld_products(pages: DataFrame, html: str = "html") -> DataFrame:
    """Products in a page's JSON-LD, alone, in a list or under @graph."""
    blocks = pages.withColumn("_j", F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))))
    listed = F.from_json("_j", f"array<struct<{_PRODUCT}>>")
    single = F.from_json("_j", f"struct<{_PRODUCT},`@graph`:array<struct<{_PRODUCT}>>>")
    alone = F.array(F.struct(*[single[c].alias(c) for c in ("@type", "name", "sku", "gtin13", "brand", "offers")]))
    nodes = F.when(F.ltrim("_j").startswith("["), listed).otherwise(F.coalesce(single["@graph"], alone))
    rows = blocks.select(*[c for c in pages.columns if c != html], F.explode(nodes).alias("p")).filter(F.col("p.@type") == "Product")
    return rows.select(*[c for c in pages.columns if c != html], "p.name", "p.sku", F.col("p.gtin13").alias("ean"), F.col("p.brand.name").alias("brand"), amount(F.col("p.offers.price")).alias("price"), F.col("p.offers.priceCurrency").alias("currency"), F.col("p.offers.availability").contains("InStock").alias("in_stock"))


#: Where each kind of store reply keeps a product's fields (schema of the reply, rows, id, name, brand, price, in stock).
ADAPTERS = {
    "vtex": ("array<struct<productId:string,productName:string,brand:string,items:array<struct<sellers:array<struct<commertialOffer:struct<Price:double,AvailableQuantity:int>>>>>>>", "r", "p.productId", "p.productName", "p.brand", "get(get(p.items, 0).sellers, 0).commertialOffer.Price", "get(get(p.items, 0).sellers, 0).commertialOffer.AvailableQuantity > 0"),
    "woostore": ("array<struct<id:string,name:string,prices:struct<price:string,currency_minor_unit:int>,is_in_stock:boolean>>", "r", "p.id", "p.name", "CAST(NULL AS STRING)", "p.prices.price / power(10, p.prices.currency_minor_unit)", "p.is_in_stock"),
    "shopify": ("struct<products:array<struct<id:string,title:string,vendor:string,variants:array<struct<price:string,available:boolean>>>>>", "r.products", "p.id", "p.title", "p.vendor", "CAST(get(p.variants, 0).price AS DOUBLE)", "get(p.variants, 0).available"),
    "magento": ("struct<data:struct<products:struct<items:array<struct<sku:string,name:string,stock_status:string,price_range:struct<minimum_price:struct<final_price:struct<value:double>>>>>>>>", "r.data.products.items", "p.sku", "p.name", "CAST(NULL AS STRING)", "p.price_range.minimum_price.final_price.value", "p.stock_status = 'IN_STOCK'"),
    "arigato": ("struct<parent_id:struct<groups:array<struct<doclist:struct<docs:array<struct<id:string,sku:string,name:string,brand:string,price:double,stock:double>>>>>>>", "transform(r.parent_id.groups, g -> get(g.doclist.docs, 0))", "p.id", "p.name", "p.brand", "p.price", "coalesce(p.stock, 0) > 0"),
    "kromi": ("struct<item:array<struct<code:string,name:string,price:double,priceO:double,impuesto:double,stock:double,c_codmoneda:struct<simbolo:string>>>>", "filter(r.item, i -> i.c_codmoneda.simbolo = '$')", "p.code", "regexp_replace(p.name, '(?i)[ ]+prs$', '')", "CAST(NULL AS STRING)", "round(IF(p.priceO > 0, p.priceO, p.price) * (1 + coalesce(p.impuesto, 0) / 100), 2)", "p.stock > 0"),
    "readdy": ("array<struct<code:string,name:string,price_retail1:string,stock_sede2:double,stock_sede3:double>>", "r", "p.code", "p.name", "CAST(NULL AS STRING)", "try_cast(p.price_retail1 AS DOUBLE)", "coalesce(p.stock_sede2, 0) + coalesce(p.stock_sede3, 0) > 0"),
    "medusa": ("struct<products:array<struct<id:string,title:string,variants:array<struct<calculated_price:struct<calculated_amount:double>,inventory_quantity:int>>>>>", "r.products", "p.id", "p.title", "CAST(NULL AS STRING)", "get(p.variants, 0).calculated_price.calculated_amount", "get(p.variants, 0).inventory_quantity > 0"),
}


def store_offers(replies: DataFrame, platform: str, body: str = "body") -> DataFrame:
    """Offers of a store's search reply that have an id, a name and a price above 0: other columns, id, name, brand, price (double), in_stock."""
    schema, rows, *fields = ADAPTERS[platform]
    kept = [c for c in replies.columns if c != body]
    opened = replies.select(*kept, F.from_json(body, schema).alias("r")).select(*kept, F.explode(F.expr(rows)).alias("p"))
    return _sold(opened.select(*kept, *[F.expr(f).alias(n) for f, n in zip(fields, OFFER, strict=True)]))


OFFER = ("id", "name", "brand", "price", "in_stock")


def _sold(offers: DataFrame) -> DataFrame:
    return offers.withColumn("name", without_tags(F.col("name"))).filter("id <> '' AND name <> '' AND price > 0")


#: Where the result pages of two kinds of store hold a product (block, id, name, price zone, mark of one out of stock).
HTML_ADAPTERS = {
    "woocommerce": (r'(?s)<li[^>]*class="[^"]*\btype-product\b.*?</li>', r'data-product_id="([0-9]+)"', r'(?s)woocommerce-loop-product__title">(.*?)</h[23]>', r"(?s)<bdi>(.*?)</bdi>", r'class="[^"]*\boutofstock\b'),
    "alacena": (r'(?s)<div class="producto.*?</form>', r'name="id_producto"[^>]*value="([0-9]+)"', r'(?s)nombre-producto">\s*<a[^>]*>(.*?)</a>', r'(?s)precio-producto">\s*<h5>(.*?)</h5>', None),
}


def html_offers(pages: DataFrame, platform: str, html: str = "html") -> DataFrame:
    """Offers on a store's result page, as store_offers; the price within <ins>, where there is one, is the one in force."""
    block, id_, name, price, gone = HTML_ADAPTERS[platform]
    kept = [c for c in pages.columns if c != html]
    b = F.col("_b")
    opened = pages.select(*kept, F.explode(F.regexp_extract_all(html, F.lit(block), F.lit(0))).alias("_b"))
    offer = F.regexp_extract(b, r"(?s)<ins[^>]*>(.*?)</ins>", 1)
    zone = F.regexp_extract(F.when(offer != "", offer).otherwise(b), price, 1)
    fields = [F.regexp_extract(b, id_, 1), F.regexp_extract(b, name, 1), F.lit(None).cast("string"), amount(without_tags(zone)).cast("double"), ~b.rlike(gone) if gone else F.lit(True)]
    return _sold(opened.select(*kept, *[f.alias(n) for f, n in zip(fields, OFFER, strict=True)]))


def page_flow(html: Column) -> Column:
    """The text that a page hands its scripts in escaped pieces, joined."""
    pieces = F.regexp_extract_all(html, F.lit(r'self\.__next_f\.push\(\[1,("(?:[^"\\]|\\.)*")\]\)'), F.lit(1))
    return F.array_join(F.from_json(F.concat(F.lit("["), F.array_join(pieces, ","), F.lit("]")), "array<string>"), "")


def enclosing_objects(text: str | None, mark: str) -> list[str]:
    """For each mark in a JSON-like text the innermost object around it; braces inside strings don't count.  One pass over the text."""
    marks, opened, waiting, out = deque(m.start() for m in re.finditer(re.escape(mark), text or "")), [], {}, {}
    for token in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}]' if marks else "(?!)", text or ""):
        at = token.start()
        while marks and marks[0] <= at:
            waiting.setdefault(opened[-1] if opened else -1, []).append(marks.popleft())
        if token.group() == "{":
            opened.append(at)
        elif token.group() == "}" and opened:
            start = opened.pop()
            out |= dict.fromkeys(waiting.pop(start, []), text[start : at + 1])
    return [out[m] for m in sorted(out)]


def flow_offers(pages: DataFrame, html: str = "html") -> DataFrame:
    """Offers of a store whose result page carries its products (those with an `ean` list) in the page flow; one of each slug."""
    kept = [c for c in pages.columns if c != html]

    @F.pandas_udf("array<string>")
    def objects(flows: pd.Series) -> pd.Series:
        return flows.map(lambda t: enclosing_objects(t, '"ean":['))

    product = "struct<name:string,price:double,slug:string,sku:string,ean:array<string>,isAvailable:boolean,stock:double>"
    rows = pages.select(*kept, F.posexplode(F.transform(objects(page_flow(F.col(html))), lambda o: F.from_json(o, product))).alias("_n", "p")).filter("p.slug RLIKE '^[a-z0-9-]+$' AND p.name <> ''")
    first = rows.groupBy(*kept, F.col("p.slug").alias("_slug")).agg(F.min_by("p", "_n").alias("p"))
    free = F.coalesce("p.isAvailable", F.lit(True)) & (F.coalesce("p.stock", F.lit(1.0)) > 0)
    out = first.select(*kept, F.coalesce(F.nullif("p.sku", F.lit("")), "p.slug").alias("id"), F.col("p.name").alias("name"), F.lit(None).cast("string").alias("brand"), F.col("p.price").alias("price"), free.alias("in_stock"))
    return _sold(out)


#: Units that close a line of the printed tariff; blanks inside one are optional.
TARIFF_UNITS = (
    "u", "kg", "l", "m", "m²", "m³", "2u", "1000 kWh", "kWh", "kg N", "kg P2O5", "kg K2O", "g", "ct", "carat", "kg met.am.", "10^3", "TJ", "1000 u", "12u", "kg 90% sdt", "kg H2O2", "kg KOH",
    "kg NaOH", "kg U", "kg net eda", "l alc. 100%", "GI F/S", "kg/net eda",
)
CONTINUED, BETWEEN = 5, 3  # lines below a code's line, fields between rate and unit


def _code_parts(line: Column) -> Column:
    """Parts of the dotted code that a line begins with; an empty list where it begins with none or has nothing behind it."""
    fields = F.split(F.trim(line), r"\s+")
    first = F.element_at(fields, 1)
    parts = F.split(first, r"\.")
    figures = F.translate(first, ".0123456789", "") == ""
    groups = F.forall(F.slice(parts, 2, 9), lambda x: F.length(x).between(1, 2)) & F.size(parts).between(2, 4) & (F.length(parts[0]) == 4)
    return F.when(figures & groups & (F.size(fields) > 1), parts).otherwise(F.array().cast("array<string>"))


def _is_row(line: Column) -> Column:
    return F.size(_code_parts(line)) == 4


def printed_tariff(pages: DataFrame, text: str = "text") -> DataFrame:
    """Rows of a tariff printed in columns: code, description, rate and unit (null where not printed); other columns stay.

    A row is the line of a code of four parts and up to five lines below it, until the next code or a blank line.  Columns stand two
    blanks or more apart: a line whose last field is a unit has its rate among the few fields before; the last such line counts.  Lines
    of figures and capitals alone are not part of the description.
    """
    kept = [c for c in pages.columns if c != text]
    units = F.array(*(F.lit(u.replace(" ", "")) for u in TARIFF_UNITS))
    lines = pages.select(*kept, F.split(text, r"\r?\n").alias("_lines")).withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_lines"))))
    opened = lines.filter(_is_row(F.element_at("_lines", F.col("_at")))).select(*kept, F.slice("_lines", F.col("_at"), F.lit(CONTINUED + 1)).alias("_block"))
    ends = F.filter(F.sequence(F.lit(2), F.size("_block") + 1), lambda i: (i > F.size("_block")) | (F.trim(F.get("_block", i - 1)) == "") | (F.size(_code_parts(F.get("_block", i - 1))) > 1))
    block = opened.withColumn("_block", F.slice("_block", F.lit(1), F.array_min(ends) - 1))

    def numeric(field: Column) -> Column:
        figures = F.regexp_replace(F.regexp_replace(field, "(BK|BIT)$", ""), ",", ".")
        return (F.translate(figures, ".0123456789", "") == "") & (figures.try_cast("double") < 100) & ~figures.startswith(".")

    def read_line(line: Column, i: Column) -> Column:
        fields = F.split(F.rtrim(line), "[ ]{2,}")
        n = F.size(fields)
        rates = F.filter(F.sequence(F.greatest(n - 1 - BETWEEN, F.lit(2)), F.greatest(n - 1, F.lit(2))), lambda k: numeric(F.get(fields, k - 1)))
        closes = F.array_contains(units, F.replace(F.element_at(fields, -1), F.lit(" "))) & (n > 2) & (F.size(rates) > 0)
        said = F.when(closes, F.slice(fields, F.lit(1), F.array_min(rates) - 1)).otherwise(fields)
        words = F.trim(F.regexp_replace(F.array_join(said, " "), r"\s+", " "))
        words = F.when(i == 0, F.trim(F.regexp_replace(words, r"^\S+", ""))).otherwise(words)
        counts = (i == 0) | (F.translate(words, "0123456789, ABCDEFGHIJKLMNOPQRSTUVWXYZ", "") != "")
        return F.struct(F.when(counts, words).alias("said"), F.when(closes, F.get(fields, F.array_min(rates) - 1)).alias("rate"), F.when(closes, F.element_at(fields, -1)).alias("unit"))

    out = block.withColumn("_read", F.transform("_block", read_line))
    last = F.try_element_at(F.filter("_read", lambda r: r["unit"].isNotNull()), F.lit(-1))
    said = F.array_join(F.filter(F.transform("_read", lambda r: r["said"]), lambda x: x.isNotNull() & (x != "")), " ")
    code = F.array_join(_code_parts(F.get("_block", F.lit(0))), ".")
    return out.select(*kept, code.alias("code"), said.alias("description"), last["rate"].alias("rate"), last["unit"].alias("unit"))


def pasted_list(texts: DataFrame, column: str, most: int = 500) -> DataFrame:
    """Lines of a pasted list split at `;` or else `,`, quotes taken off; at most `most` lines of each text, which is the feature's limit."""
    lines = F.slice(F.filter(F.split(F.col(column), r"\r?\n"), lambda x: F.trim(x) != ""), 1, most)
    kept = [c for c in texts.columns if c != column]
    cut = texts.select(*kept, F.posexplode(lines).alias("line", "_t"))
    cells = F.when(F.contains("_t", F.lit(";")), F.split("_t", ";")).otherwise(F.split("_t", ","))
    return cut.select(*kept, (F.col("line") + 1).alias("line"), F.transform(cells, lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', ""))).alias("cells"))


def insert_statements(dump: DataFrame, column: str) -> DataFrame:
    """(table, values) of `INSERT INTO t VALUES (…)` lines; quotes doubled inside strings are one; NULL is null."""
    rows = dump.withColumn("_i", F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?is)INSERT\s+INTO\s+(?:[^;']|'(?:[^']|'')*')*;"), F.lit(0))))
    table = F.regexp_extract("_i", r"(?is)INSERT\s+INTO\s+[`\"]?([A-Za-z0-9_.]+)", 1)
    tuples = F.regexp_extract_all(F.regexp_extract("_i", r"(?is)\bVALUES\s*(.*);", 1), F.lit(r"(?s)\(((?:[^()']|'(?:[^']|'')*')*)\)"), F.lit(1))
    opened = rows.select(table.alias("table"), F.explode(tuples).alias("_v"))
    cells = F.regexp_extract_all("_v", F.lit(r"(?s)('(?:[^']|'')*'|[^,\s][^,]*)"), F.lit(1))
    clean = lambda c: F.when(F.upper(F.trim(c)) == "NULL", F.lit(None)).otherwise(F.regexp_replace(F.regexp_replace(F.trim(c), "^'|'$", ""), "''", "'"))
    return opened.select("table", F.transform(cells, clean).alias("values"))


def front_page_rates(pages: DataFrame, currencies: list[str], html: str = "html") -> DataFrame:
    """(currency, rate) of the first decimal after each currency's name on a bank's front page."""
    found = F.array(*[F.struct(F.lit(c).alias("currency"), amount(F.regexp_extract(html, rf"(?s)\b{c}\b.{{0,400}}?([0-9][0-9.]*,[0-9]+)", 1)).alias("rate")) for c in currencies])
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.explode(found).alias("r")).select(*kept, "r.*").filter("rate IS NOT NULL")
