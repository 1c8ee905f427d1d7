"""Stand-in views over the given test tables (whole tables, no sampling).

catalog      part (+ embeddings by vec_id = p_partkey)
lines        every lineitem row as a free-text order line of its order
text_files   documents, one file per row
shopping     structured offers derived from lineitem x part x supplier
organic      organic search results derived from lineitem x part
questions    view events (one question per view, per user = session)
choices      purchase/click/error/signup events as answers
members      view / click events as joins / leaves
changes      catalog changes derived from part attributes
model_text   stored model responses derived from events.props

The same definitions are written in SQL in ``penawar.plans.oracle`` for the
DuckDB check; keep both in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penawar.functions.text import once
from penawar.operators.chunks import running
from penawar.session import shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the reader (file listing, footers) is built once per session."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(key[1])
    return _TABLES[key]


def catalog_name(p: str = "") -> F.Column:
    c = lambda x: F.col(f"{p}{x}")
    return F.concat(c("p_name"), F.lit(" "), c("p_brand"), F.lit(" "), c("p_type"), F.lit(" size "),
                    c("p_size").cast("string"))


def catalog(spark: SparkSession, sf_dir: str, with_embedding: bool = True) -> DataFrame:
    part = table(spark, sf_dir, "part")
    cat = part.select(
        F.col("p_partkey").alias("id"),
        catalog_name().alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(15,2)").alias("price"),
        F.lit("pcs").alias("unit"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )
    if not with_embedding:
        return cat
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return cat.join(emb, "id", "left")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def line_variant() -> F.Column:
    """Name as a customer writes it, chosen by line number: full, no brand,
    no size, or the second letter dropped together with a size no catalog row
    has (size + 50), which the catalog cannot serve."""
    full = catalog_name()
    no_brand = F.concat_ws(" ", "p_name", "p_type", F.lit("size"), F.col("p_size").cast("string"))
    no_size = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    other = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" "), F.col("p_type"), F.lit(" size "),
                     (F.col("p_size") + 50).cast("string"))
    typo = F.concat(other.substr(F.lit(1), F.lit(1)), other.substr(F.lit(3), F.length(other)))
    k = F.col("l_linenumber") % 4
    return F.when(k == 0, full).when(k == 1, no_brand).when(k == 2, no_size).otherwise(typo)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINES(session_id, line_index, raw_text, qvec_id) for every lineitem row."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return once(
        li.join(part, li.l_partkey == part.p_partkey)
        .withColumn("line_index", F.row_number().over(w) - 1)
        .select(
            F.col("l_orderkey").cast("string").alias("session_id"),
            "line_index",
            F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" pcs "), line_variant()).alias("raw_text"),
            F.col("l_partkey").alias("qvec_id"),
        ), "raw_text")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "source",
                                                   F.col("text").alias("content"))


def order_files(spark: SparkSession, sf_dir: str, orders_per_file: int = 5000) -> str:
    """A folder of order lists as text files, one per ``orders_per_file`` order keys, with the lines of LINES in order:
    some end in CR LF and are indented, some are blank."""
    raw, at = F.col("raw_text"), F.col("line_index")
    text = F.when(at % 5 == 4, F.lit("\t\r")).when(at % 3 == 1, F.concat(F.lit("  "), raw, F.lit("\r"))).otherwise(raw)
    order = F.col("session_id").cast("long")
    path = shared_folder(spark, "order-files")
    (lines(spark, sf_dir).select(F.floor(order / orders_per_file).alias("list"), order.alias("_order"), "line_index", text.alias("value"))
     .repartition("list").sortWithinPartitions("list", "_order", "line_index").select("list", "value")
     .write.partitionBy("list").text(path))
    return path


def _id_fmt(x: F.Column) -> F.Column:
    """Indonesian money text of a two-decimal amount: 1.234.567,50."""
    whole = F.translate(F.format_number(F.floor(x), 0), ",", ".")
    cents = F.lpad((F.round(x * 100).cast("bigint") % 100).cast("string"), 2, "0")
    return F.concat(whole, F.lit(","), cents)


def _offer_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x part with the query text and a result position unique within it.

    pos = order key * 10 million + position of the line in its order; it is built
    from the small per-order window, never from a window over the query
    (a query may hold a large share of all rows)."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    li = li.withColumn("pos", F.col("l_orderkey") * 10_000_000 + F.row_number().over(w) - 1)
    return once(li.join(part, li.l_partkey == part.p_partkey).withColumn("query", line_variant()), "query")


def shopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured shopping results for the text a line searches; only names
    before 'n' have a price, the others fall back to organic results."""
    sup = table(spark, sf_dir, "supplier")
    served = F.col("p_name") < "n"
    b = _offer_base(spark, sf_dir)
    b = b.join(sup, b.l_suppkey == sup.s_suppkey, "left")
    odd = F.col("l_linenumber") % 2 == 1
    return b.select(
        "query",
        "pos",
        F.when(odd & served, F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice"))).alias("extracted_price"),
        F.when(~odd & served, F.concat(F.lit("Rp "), _id_fmt(F.col("l_extendedprice")))).alias("price"),
        F.when(F.col("s_nationkey") == 0, F.lit("")).when(F.col("l_suppkey") % 10 == 0, F.lit(None)).otherwise(F.col("s_name")).alias("source"),
        catalog_name().alias("title"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("https://shop.example/p/"), F.col("l_partkey").cast("string"), F.lit("-"),
                     F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))).alias("product_link"),
        F.concat(F.lit("https://shop.example/s/"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("link"),
    )


def organic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organic results with snippets carrying prices in several shapes."""
    b = _offer_base(spark, sf_dir)
    k = F.col("l_linenumber") % 4
    price = F.concat(F.lit("Rp "), _id_fmt(F.col("l_extendedprice")))
    snippet = (
        F.when(k == 0, F.concat(F.lit("Harga "), price, F.lit(" stok ada")))
        .when((k == 1) & (F.col("l_partkey") % 2 == 0), F.concat(F.lit("Harga "), price, F.lit(" atau cicilan Rp "), _id_fmt(F.col("l_tax") * 1000 + 1), F.lit("/bln")))
        .when(k == 1, F.concat(F.lit("Cicilan "), F.lit("Rp "), _id_fmt(F.col("l_tax") * 1000 + 1), F.lit("/bln untuk 12 bln")))
        .when(k == 2, F.concat(F.lit("Diskon dari Rp "), _id_fmt(F.col("l_extendedprice") + 1000), F.lit(" jadi "), price))
        .otherwise(F.lit("Hubungi penjual"))
    )
    return b.select(
        "query",
        "pos",
        catalog_name().alias("title"),
        snippet.alias("snippet"),
        F.when(F.col("l_suppkey") % 5 > 0, F.concat(
            F.lit("https://toko"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".example/item/"),
            F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))).otherwise(F.lit("item")).alias("link"),
    )


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _by_user(ev: DataFrame, value: F.Column, name: str) -> DataFrame:
    """Running sum of ``value`` per user in time order, by hourly chunks: a user with most events is no single task."""
    return running(ev, ["user_id"], F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600), ["ts", "event_id"], value, name)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per view event; session = user; even lines ask about
    catalog candidates, odd lines about internet offers. A question is asked
    4 minutes before the user's next event (so that event answers in time),
    except every third view, asked at the view itself."""
    ev = _by_user(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), F.lit(1), "n")
    after = ev.select(F.col("user_id").alias("u2"), (F.col("n") - 1).alias("n2"), F.col("ts").alias("next_ts"))
    ev = ev.join(after, (F.col("user_id") == F.col("u2")) & (F.col("n") == F.col("n2")), "left")
    ev = _by_user(ev.filter(F.col("event_type") == "view"), F.lit(1), "v")
    asked = F.when((F.col("event_id") % 3 == 0) | F.col("next_ts").isNull(), F.col("ts")).otherwise(
        F.greatest(F.col("ts"), F.col("next_ts") - F.expr("INTERVAL 4 MINUTES")))
    q = ev.select(
        F.col("user_id").cast("string").alias("session_id"),
        (F.col("v") - 1).cast("int").alias("line_index"),
        asked.alias("asked_at"),
        F.concat(F.lit("barang "), F.col("event_id").cast("string")).alias("name"),
        "user_id",
    )
    return q.withColumn("reason", F.when(F.col("line_index") % 2 == 0, "ambiguous").otherwise("internet_fallback"))


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: each non-view event answers the latest question of its user
    asked at or before it (line_index -1 when none was asked yet)."""
    ev = _events(spark, sf_dir)
    ev = _by_user(ev, F.when(F.col("event_type") == "view", 1).otherwise(0), "n_views")
    kind = (F.when(F.col("event_type") == "purchase", "product").when(F.col("event_type") == "click", "internet")
            .when(F.col("event_type") == "error", "cancel").otherwise("other"))
    return ev.filter(F.col("event_type") != "view").select(
        F.col("user_id").cast("string").alias("session_id"),
        (F.col("n_views") - 1).cast("int").alias("line_index"),
        kind.alias("type"),
        F.when(kind == "product", (F.col("user_id") * 8 + F.col("event_id") % 10).cast("string")).alias("id"),
        F.when((kind == "internet") & (F.col("event_id") % 6 != 4),
               F.concat(F.lit("https://shop.example/s/"), F.col("user_id").cast("string"), F.lit("-"),
                        (F.col("event_id") % 6).cast("string"))).alias("url"),
        F.col("ts").alias("at"),
        "event_id",
    )


def question_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates shown with each question: catalog rows user*8 .. user*8+7 for
    catalog questions, five shop offers for internet questions."""
    q = questions(spark, sf_dir)
    cat = catalog(spark, sf_dir, with_embedding=False)
    db = (q.filter(F.col("reason") == "ambiguous")
          .select("session_id", "line_index", "user_id", F.posexplode(F.sequence(F.lit(0), F.lit(7))).alias("rank0", "j"))
          .withColumn("cid", F.col("user_id") * 8 + F.col("j")))
    db = db.join(cat, db.cid == cat.id).select(
        "session_id", "line_index", (F.col("rank0") + 1).alias("rank"), F.col("id").cast("string").alias("id"),
        "name", "brand", "category", F.col("price").cast("double").alias("price"), "unit",
        F.lit(None).cast("string").alias("supplier"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("title"))
    net = (q.filter(F.col("reason") == "internet_fallback")
           .select("session_id", "line_index", "user_id", F.posexplode(F.sequence(F.lit(0), F.lit(4))).alias("rank0", "j")))
    net = net.select(
        "session_id", "line_index", (F.col("rank0") + 1).alias("rank"), F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("brand"),
        F.lit(None).cast("string").alias("category"),
        (F.col("user_id") * 1000 + F.col("j") * 10 + 5).cast("double").alias("price"), F.lit(None).cast("string").alias("unit"),
        F.concat(F.lit("Toko "), F.col("j").cast("string")).alias("supplier"),
        F.when(F.col("j") != 4, F.concat(F.lit("https://shop.example/s/"), F.col("user_id").cast("string"), F.lit("-"),
                                         F.col("j").cast("string"))).alias("url"),
        F.when(F.col("j") != 2, F.concat(F.lit("Offer "), F.col("j").cast("string"))).alias("title"))
    return db.unionByName(net)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).filter(F.col("event_type").isin("view", "click"))
    return ev.select(F.col("user_id").cast("string").alias("session_id"), "ts", "event_id",
                     F.when(F.col("event_type") == "view", 1).otherwise(-1).alias("delta"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog changes chosen by part attributes.

    size 7 price + 1; size 11 new name; size 13 delete; size 17 update of an
    unknown id; size 19 negative price; size 23 blank name; size 29 create;
    size 31 update of brand to blank and unit to ' box '; size 37 empty update.
    Beside these, for every part of size 13 an update before and one after the delete and a second
    delete, and for every part of size 29 an update of the id that the create before it gets.
    """
    p = table(spark, sf_dir, "part")
    s = F.col("p_size")
    op = (F.when(s.isin(7, 11, 17, 19, 23, 31, 37), "update").when(s == 13, "delete").when(s == 29, "create"))
    rows = p.filter(s.isin(7, 11, 13, 17, 19, 23, 29, 31, 37))
    rows = rows.select(
        op.alias("op"),
        F.when(s == 29, F.lit(None).cast("bigint")).when(s == 17, F.col("p_partkey") + 1000000).otherwise(F.col("p_partkey")).alias("id"),
        F.when(s == 11, F.concat(F.col("p_name"), F.lit(" v2"))).when(s == 23, F.lit("  "))
        .when(s == 29, F.concat(F.col("p_name"), F.lit(" baru"))).alias("name"),
        F.when(s == 31, F.lit(" ")).when(s == 29, F.col("p_brand")).alias("brand"),
        F.when(s == 29, F.col("p_type")).alias("category"),
        F.when(s == 31, F.lit(" box ")).alias("unit"),
        F.when(s.isin(7, 17), (F.col("p_retailprice") + 1).cast("string")).when(s == 19, F.lit("-1"))
        .when(s == 29, F.col("p_retailprice").cast("string")).alias("price"),
        (s.isin(11, 23, 29)).alias("has_name"),
        (s.isin(31, 29)).alias("has_brand"),
        (s == 29).alias("has_category"),
        (s == 31).alias("has_unit"),
        (s.isin(7, 17, 19, 29)).alias("has_price"),
        (F.col("p_partkey") * 10 + 5).alias("change_id"),
    )
    none = lambda t: F.lit(None).cast(t)
    typed = {c: none(t) for c, t in rows.dtypes}
    flags = {c: F.lit(False) for c in rows.columns if c.startswith("has_")}

    def more(src: DataFrame, no: int, op: str, ident: F.Column, **sent: F.Column) -> DataFrame:
        cols = {**typed, **flags, **sent, **{f"has_{k}": F.lit(True) for k in sent}, "op": F.lit(op), "id": ident,
                "change_id": F.col("p_partkey") * 10 + no}
        return src.select(*[cols[c].alias(c) for c in rows.columns])

    gone = p.filter(s == 13)
    made = p.filter(s == 29)
    # the new ids follow the largest part key in change order
    nth = running(made, [], F.floor(F.col("p_partkey") / 1000), ["p_partkey"], F.lit(1), "nth")
    top = p.agg(F.max("p_partkey").alias("top")).withColumn("k", F.lit(1))
    nth = nth.withColumn("k", F.lit(1)).join(F.broadcast(top), "k")
    parts = [more(gone, 3, "update", F.col("p_partkey"), price=F.lit("7.5")), more(gone, 7, "update", F.col("p_partkey"), name=F.lit("late")),
             more(gone, 8, "delete", F.col("p_partkey")),
             more(nth, 7, "update", F.col("top") + F.col("nth"), unit=F.lit("dus"), price=F.lit("2"))]
    for x in parts:
        rows = rows.unionByName(x)
    return rows


def model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model responses: events.props wrapped in the shapes models write."""
    ev = _events(spark, sf_dir)
    t = F.col("event_type")
    p = F.col("props")
    text = (F.when(t == "click", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
            .when(t == "view", F.concat(F.lit("Here you go: "), p, F.lit(" hope it helps")))
            .when(t == "purchase", F.concat(F.lit("```\n["), p, F.lit(", "), p, F.lit("]\n```")))
            .when(t == "error", F.concat(F.lit("broken {"), F.col("user_id").cast("string")))
            .otherwise(F.col("value").cast("string")))
    return ev.select("event_id", text.alias("text"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RESULTS stand-in: every lineitem row as a finished line.

    Returned lines (flag R) have no price; status O lines came from the
    internet with the tax as margin; the rest matched the catalog; a zero
    discount marks a line that failed with an error.
    """
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    w = Window.partitionBy("session_id").orderBy(*LINE_ORDER)
    b = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey, "left")
    # numbered before the texts are made: the window shuffles the columns that they are made of
    b = b.withColumn("session_id", F.col("l_orderkey").cast("string")).withColumn("line_index", F.row_number().over(w) - 1)
    err = F.col("l_discount") == 0
    src = (F.when(err, "error").when(F.col("l_returnflag") == "R", "not_found")
           .when(F.col("l_linestatus") == "O", "user_selected_internet").otherwise("auto_database"))
    product = (F.when(src == "auto_database", F.struct(F.col("p_partkey").cast("string").alias("id"), catalog_name().alias("name"),
                                                       F.lit(None).cast("string").alias("supplier"), F.lit(None).cast("string").alias("url")))
               .when(src == "user_selected_internet", F.struct(F.lit(None).cast("string").alias("id"),
                                                                F.when(F.col("l_linenumber") % 2 == 0, catalog_name()).alias("name"),
                                                                F.col("s_name").alias("supplier"),
                                                                F.concat(F.lit("https://shop.example/s/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("url"))))
    return b.select(
        "session_id",
        "line_index",
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" pcs "), line_variant()).alias("raw_text"),
        line_variant().alias("name"),
        F.col("l_quantity").alias("qty"),
        F.lit("pcs").alias("unit"),
        F.when(src.isin("auto_database", "user_selected_internet"), F.col("p_retailprice")).alias("price"),
        src.alias("source"),
        F.when(src == "user_selected_internet", F.col("l_tax") * 100).alias("margin"),
        F.when(err, F.lit("provider failed")).alias("error"),
        product.alias("product"),
        F.col("l_shipdate").alias("_shown_at"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query embedding provider as a stored table: a line's vector is the
    embedding stored for its part (lines without one search by trigram only)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qvec_id"), F.col("embedding").alias("qvec"))


def rerank_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model verdicts for every catalog question, in the shapes models write."""
    q = questions(spark, sf_dir).where(F.col("reason") == "ambiguous")
    li = F.col("line_index")
    cid = (F.col("user_id") * 8 + li % 10).cast("string")
    conf = ((li % 6) * 0.25).cast("string")
    body = F.concat(F.lit('{"id": '), F.when(li % 13 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), cid, F.lit('"'))),
                    F.lit(', "confidence": '), conf, F.lit(', "reason": "r'), li.cast("string"), F.lit('"}'))
    text = (F.when(li % 11 == 0, F.lit("sorry, cannot decide"))
            .when(li % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .otherwise(body))
    return q.select("session_id", "line_index", text.alias("response"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual edits typed into result rows, chosen by line attributes."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    li = li.withColumn("line_index", F.row_number().over(w) - 1)
    k = F.col("l_linenumber")
    return li.where(k.isin(1, 2, 3)).select(
        F.col("l_orderkey").cast("string").alias("session_id"), "line_index",
        F.when(k == 1, F.lit("12,5")).alias("qty_text"),
        F.when(k == 2, F.lit(" dus ")).alias("unit_text"),
        F.lit(None).cast("string").alias("name_text"),
        F.when(k == 3, F.lit("Barang manual")).alias("product_text"),
        F.when((k == 1) & (F.col("l_returnflag") == "A"), F.lit("")).when(k == 3, F.lit("Rp 1.500")).alias("price_text"),
        F.when(k == 2, F.lit("10")).alias("margin_text"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start requests: one per order with the number of its lines (session id blank for status P,
    no line list for priority 5-LOW)."""
    o = table(spark, sf_dir, "orders")
    ln = lines(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    j = o.join(ln, o.o_orderkey.cast("string") == ln.session_id, "left")
    has = F.col("o_orderpriority") != "5-LOW"
    return j.select("o_orderkey",
                    F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderkey").cast("string")).alias("session_id"),
                    has.alias("has_lines"), F.when(has, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("int").alias("n_lines"))


def events_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a session as started over time: every event of a user is a line
    start (session = user, started_at = ts)."""
    ev = _by_user(_events(spark, sf_dir), F.lit(1), "n")
    return ev.select(F.col("user_id").cast("string").alias("session_id"),
                     (F.col("n") - 1).cast("int").alias("line_index"), F.col("ts").alias("started_at"))


def extraction_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored extraction answers for every order line, in the shapes models write:
    fenced JSON, bare JSON with a text quantity, prose around JSON, or no JSON."""
    # no filter of a join's keys reaches the lines through an explode: they are read as by their other readers, so one
    # shuffle serves both
    ln = once(lines(spark, sf_dir), "session_id")
    k = F.col("line_index") % 4
    name = F.regexp_replace("raw_text", r"^\d+ pcs ", "")
    qty = F.regexp_extract("raw_text", r"^(\d+)", 1)
    body = F.concat(F.lit('{"name": "'), name, F.lit('", "qty": '), F.when(k == 1, F.concat(F.lit('"'), qty, F.lit('"')))
                    .otherwise(qty), F.lit(', "unit": "'), F.when(k == 2, F.lit("")).otherwise(F.lit("pcs")), F.lit('"}'))
    text = (F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(k == 1, body).when(k == 2, F.concat(F.lit("Hasil: "), body, F.lit(" selesai")))
            .otherwise(F.lit("maaf, tidak bisa")))
    return ln.select("session_id", "line_index", text.alias("response"))


def offer_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model answers to the organic search of every line, keyed by order and line: fenced arrays, an object
    where an array is due, prose, and entries with missing fields or unreadable prices."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    li = li.withColumn("n", F.row_number().over(w) - 1)
    k = F.col("l_linenumber") % 4
    price = F.col("l_extendedprice").cast("bigint").cast("string")
    entry = lambda sup, p: F.concat(F.lit('{"supplier":"'), sup, F.lit('","price":"'), p, F.lit('","url":""}'))
    arr = F.concat(F.lit("["), entry(F.lit("Toko A"), price), F.lit(","), entry(F.lit(""), F.lit("Rp 1.500")), F.lit(","),
                   entry(F.lit("Toko B"), F.lit("murah")), F.lit("]"))
    text = (F.when(k == 0, F.concat(F.lit("```json\n"), arr, F.lit("\n```"))).when(k == 1, entry(F.lit("Toko A"), price))
            .when(k == 2, F.concat(F.lit("Hasil: "), arr)).otherwise(F.lit("tidak ada")))
    return li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("n").cast("string")).alias("query"), text.alias("response"))


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search text per (name, type) of the whole part table, with the vector of its smallest part: the full catalog
    name, name and type, these with a size that no part has, or a text that nothing resembles."""
    part = table(spark, sf_dir, "part")
    first = part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("qvec_id"))
    p = part.join(first.select("qvec_id"), F.col("p_partkey") == F.col("qvec_id"))
    k = F.col("qvec_id") % 4
    short = F.concat_ws(" ", "p_name", "p_type")
    text = (F.when(k == 0, catalog_name()).when(k == 1, short).when(k == 2, F.concat(short, F.lit(" size 99")))
            .otherwise(F.concat(F.lit("xyzzy "), F.col("qvec_id").cast("string"), F.lit("q"))))
    return p.select(text.alias("name"), "qvec_id")
