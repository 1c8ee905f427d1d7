"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads whole test tables (through the stand-ins of
``penawar.sources.fixtures``); none samples, filters ids or caps rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penawar.functions import text as tx
from penawar.operators import catalog as cat_ops
from penawar.operators import quote, sinks
from penawar.operators.versions import published
from penawar.sources import fixtures as fx
from penawar.session import cut_files, shared_folder
from penawar.sources import lines as src_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- sources


@query
def lines_from_text(spark, d):
    """Every document as an uploaded text file, split into numbered lines."""
    return src_lines.lines_from_text(fx.text_files(spark, d), ["file_id"])


@query
def lines_from_files(spark, d):
    """Order lists in text files, numbered across the byte ranges that Spark cuts them into."""
    got = src_lines.lines_from_files(spark, fx.order_files(spark, d))
    return got.select(F.regexp_extract("path", r"list=(\d+)", 1).cast("long").alias("list"), "line_index", "line")


@query
def lines_from_table(spark, d):
    """Every customer row as a spreadsheet row -> one line; two cells are whole numbers in doubles."""
    whole = F.floor(F.abs("c_acctbal")).cast("double")
    c = fx.table(spark, d, "customer").withColumns({"qty": whole, "price": whole * 100000})
    return src_lines.lines_from_table(c, ["c_custkey"], ["c_name", "c_nationkey", "c_acctbal", "qty", "price", "c_mktsegment"])


@query
def lines_from_paste(spark, d):
    """S3: every turn of the conversations as pasted text."""
    conv = fx.table(spark, d, "conversations")
    return src_lines.lines_from_text(conv, ["conv_id", "turn"], "text")


@query
def skip_blank_lines(spark, d):
    """P5: sentences of every document; blank pieces skipped, indices kept."""
    return src_lines.lines_keep_gaps(fx.text_files(spark, d), ["file_id"], "content", "\\.")


@query
def catalog_scan(spark, d):
    """The catalog with its embedding dimension."""
    c = fx.catalog(spark, d)
    return c.select("id", "name", "brand", "category", "price", "unit", "created_at",
                    F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims"))


@query
def catalog_align(spark, d):
    """A partial product table aligned to the catalog schema."""
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                                          F.col("p_retailprice").alias("price"))
    return cat_ops.align_schema(p).drop("embedding")


@query
def catalog_json(spark, d):
    """Output normalisation of catalog rows."""
    return cat_ops.to_json_rows(fx.catalog(spark, d, with_embedding=False))


@query
def catalog_search(spark, d):
    """Admin search for 'red' over name, brand, category."""
    return cat_ops.search_filter(fx.catalog(spark, d, with_embedding=False), "red").drop("created_at")


@query
def catalog_page(spark, d):
    """K3 + A3: third page of 25 of the rows matching 'brand#1'."""
    return cat_ops.catalog_page(fx.catalog(spark, d, with_embedding=False), "brand#1", "25", "50").drop("created_at")


@query
def catalog_page_past_end(spark, d):
    """K3 + A3: a page past the end still tells the total."""
    return cat_ops.catalog_page(fx.catalog(spark, d, with_embedding=False), "brand#1", "25", "100000000").drop("created_at")


@query
def catalog_page_deep(spark, d):
    """K3 + A3: a page behind 1,000 rows, looked up by counts per id range."""
    return cat_ops.catalog_page(fx.catalog(spark, d, with_embedding=False), "", "50", "1000", scan_rows=100).drop("created_at")


@query
def page_info(spark, d):
    """K4: paging numbers for the search of every category."""
    c = fx.catalog(spark, d, with_embedding=False)
    counts = c.groupBy("category").agg(F.count(F.lit(1)).alias("total")).withColumn("offset", F.lit(50))
    return cat_ops.page_info(counts, 25)


# ---------------------------------------------------------------- scalar functions


def _sentences(spark, d):
    conv = fx.table(spark, d, "conversations")
    return conv.select("conv_id", "turn", F.posexplode(F.split("text", "\\.")).alias("pos", "piece"))


@query
def normalise_key(spark, d):
    """Cache keys of every sentence piece of the conversations."""
    return _sentences(spark, d).select("conv_id", "turn", "pos", tx.normalise_key("piece").alias("key"))


@query
def trigrams(spark, d):
    """Trigram set of every catalog name."""
    c = fx.catalog(spark, d, with_embedding=False)
    t = tx.trigram_set("name")
    return c.select("id", F.size(t).alias("n_trigrams"), F.array_join(t, "|").alias("trigrams"))


@query
def parse_price(spark, d):
    """Price text of every structured offer and snippet."""
    s = fx.shopping(spark, d).select("query", "pos", F.col("price").alias("text"))
    o = fx.organic(spark, d).select("query", "pos", F.col("snippet").alias("text"))
    return s.unionByName(o).select("query", "pos", "text", tx.parse_price("text").alias("price"))


@query
def json_in_text(spark, d):
    """The JSON value inside every stored model response."""
    m = fx.model_text(spark, d)
    j = tx.json_in_text("text")
    return m.select("event_id", j.alias("json_text"), tx.json_parses(j).alias("parses"))


@query
def line_defaults(spark, d):
    """Defaults over extraction fields written by the line items."""
    li = fx.table(spark, d, "lineitem")
    k = F.col("l_linenumber") % 3
    qty_txt = F.when(k == 0, F.col("l_quantity").cast("int").cast("string")).when(k == 1, F.lit("0")).otherwise(F.when(F.col("l_returnflag") == "A", F.lit("5d")).otherwise(F.lit("2,5")))
    unit = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.lit("box"))
    name = F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.lit("baut"))
    raw = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                     tx.name_default(name, raw).alias("name"), tx.qty_default(qty_txt).alias("qty"),
                     tx.unit_default(unit).alias("unit"))


@query
def subtotal(spark, d):
    """Subtotal of every result line."""
    r = fx.results(spark, d)
    return r.select("session_id", "line_index", quote.subtotal().alias("subtotal"))


@query
def format_rupiah(spark, d):
    """Rupiah text of every line's extended price and of a missing price."""
    li = fx.table(spark, d, "lineitem")
    v = F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_extendedprice"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                     tx.format_rupiah(v).alias("rupiah"))


@query
def edited_number(spark, d):
    """The number a person typed: price texts of the shopping results."""
    s = fx.shopping(spark, d)
    typed = F.concat(F.col("price"), F.when(F.col("pos") % 2 == 0, F.lit("")).otherwise(F.lit(" ,5")))
    return s.select("query", "pos", typed.alias("typed"), tx.edited_number(typed).alias("number"))


@query
def status_label(spark, d):
    """Label and tone of every result's source (plus an unknown one)."""
    r = fx.results(spark, d)
    src = F.when(F.col("line_index") == 6, F.lit("mystery")).otherwise(F.col("source"))
    label, tone = tx.status_label(src)
    return r.select("session_id", "line_index", src.alias("source"), label.alias("label"), tone.alias("tone"))


@query
def embedding_text(spark, d):
    """The text embedded for every catalog row (some brands blanked)."""
    c = fx.catalog(spark, d, with_embedding=False)
    brand = F.when(F.col("category") == "PROMO", F.lit("")).otherwise(F.col("brand"))
    return c.select("id", tx.embedding_text("name", brand, "category").alias("text"))


@query
def vector_text(spark, d):
    """Every embedding as vector literal text and back."""
    e = fx.table(spark, d, "embeddings")
    lit = tx.vector_literal("embedding")
    back = tx.parse_vector_literal(lit)
    return e.select("vec_id",
                    (F.size(back) == F.size("embedding")).alias("same_size"),
                    F.aggregate(F.zip_with(back, "embedding", lambda a, b: F.abs(a - b)), F.lit(0.0).cast("float"),
                                lambda acc, x: F.greatest(acc, x)).alias("max_diff"))


@query
def cosine(spark, d):
    """T4: cosine of every embedding with the next one by id."""
    e = fx.table(spark, d, "embeddings")
    nxt = e.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("e2"))
    j = e.join(nxt, F.col("next_id") == F.col("vec_id") + 1)
    return j.select("vec_id", "next_id", F.round(tx.cosine("embedding", "e2"), 9).alias("cosine"))


# ---------------------------------------------------------------- catalog maintenance


def _applied(spark, d):
    return cat_ops.apply_changes(fx.catalog(spark, d, with_embedding=False), fx.changes(spark, d))


@query
def validate_products(spark, d):
    """V1: validation of every catalog change."""
    ch = fx.changes(spark, d).withColumn("_partial", F.col("op") != "create")
    v = cat_ops.validate(ch, partial_col="_partial")
    return v.select("change_id", "op", "clean_name", "clean_brand", "clean_category", "clean_unit",
                    F.col("clean_price").cast("double").alias("clean_price"), "error")


@query
def catalog_create(spark, d):
    """Created rows with their new ids."""
    return _applied(spark, d)["created"].drop("reembed")


@query
def catalog_update(spark, d):
    """Rows after partial updates."""
    return _applied(spark, d)["updated"].drop("created_at")


@query
def catalog_delete(spark, d):
    """The deleted rows, as returned to the caller."""
    return _applied(spark, d)["deleted"].drop("created_at")


@query
def changes_missing(spark, d):
    """Changes that name an unknown id."""
    return _applied(spark, d)["missing"].select("change_id", "op", "id", "error")


@query
def catalog_snapshot(spark, d):
    """The catalog after all changes."""
    return _applied(spark, d)["snapshot"].select("id", "name", "brand", "category", "price", "unit", "reembed")


@query
def load_summary(spark, d):
    """A5: categories of a bulk load in first-seen order."""
    rows = fx.table(spark, d, "part").select(F.col("p_partkey").alias("seed_order"), F.col("p_type").alias("category"))
    loaded = cat_ops.load_catalog(rows, 0, reset=False)
    return cat_ops.load_summary(loaded)


@query
def catalog_load(spark, d):
    """Bulk load with reset: ids restart from 1 in seed order."""
    rows = fx.table(spark, d, "part").select(F.col("p_partkey").alias("seed_order"), F.col("p_name").alias("name"))
    return cat_ops.load_catalog(rows, 1, reset=True)


# ---------------------------------------------------------------- quotation


@query
def quotation_total(spark, d):
    """A1 + A2 per session."""
    return quote.quotation_total(fx.results(spark, d))


@query
def quotation_sheet(spark, d):
    """The quotation sheet of every session."""
    return quote.quotation_sheet(fx.results(spark, d))


@query
def sheet_published(spark, d):
    """The sheet exported twice under one export id, as by a job that is run again, and read back."""
    path = shared_folder(spark, "sheets")
    sheet = quote.quotation_sheet(fx.results(spark, d)).withColumn("export_date", F.lit("2024-06-01").cast("date"))
    sheet = cut_files(sinks.deal_sheet(sheet))
    for _ in range(2):
        sinks.write_sheet(sheet, path, export_id="export-1", dealt=True)
    return published(spark, path).drop("export_date")


@query
def catalog_published(spark, d):
    """A bulk load that is run again under its load id, then read back."""
    path = shared_folder(spark, "catalog")
    rows = fx.table(spark, d, "part").select(F.col("p_partkey").alias("seed_order"), F.col("p_name").alias("name"),
                                             F.col("p_type").alias("category"))
    for _ in range(2):
        sinks.write_catalog(rows, path, load_id="load-1")
    return published(spark, path, sinks.CATALOG_SLOT).drop("category")


@query
def results_for_export(spark, d):
    """Internal fields stripped, ordered by line."""
    r = quote.results_for_export(fx.results(spark, d))
    return r.select("session_id", "line_index", "raw_text", "name", "qty", "unit", "price", "source", "margin", "error",
                    F.col("product.name").alias("product_name"), F.col("product.url").alias("product_url"))


@query
def export_dated(spark, d):
    """The sheet with its UTC export date."""
    r = fx.results(spark, d)
    return quote.export_dated(r, quote.quotation_sheet(r)).select("session_id", "sheet_row", "row_kind", "export_date")


@query
def session_results(spark, d):
    """Results packed per session."""
    return quote.session_results(fx.results(spark, d))


@query
def session_progress(spark, d):
    """Progress of every session (results with a price count as done)."""
    r = fx.results(spark, d).where(F.col("price").isNotNull())
    return quote.session_progress(fx.lines(spark, d), r)


# ---------------------------------------------------------------- matching core

from penawar.operators import embed as emb_ops  # noqa: E402
from penawar.operators import offers as off_ops  # noqa: E402
from penawar.operators import providers as prov  # noqa: E402
from penawar.operators import rerank as rr_ops  # noqa: E402
from penawar.operators import route as route_ops  # noqa: E402
from penawar.operators import search as search_ops  # noqa: E402
from penawar.operators.extract import extract_rules  # noqa: E402
from penawar.operators.similarity_join import vector_topk, vector_topk_lsh  # noqa: E402
from penawar.operators.trigram_index import trigram_topk  # noqa: E402


def _line_names(spark, d):
    return extract_rules(fx.lines(spark, d))


@query
def extract_lines(spark, d):
    """E1 + T9: name, qty and unit of every order line (default rule provider)."""
    return _line_names(spark, d).select("session_id", "line_index", "name", "qty", "unit")


@query
def trigram_search(spark, d):
    """J1 + W1 + K1: top-8 catalog rows per distinct line name by word_similarity >= 0.3."""
    names = _line_names(spark, d).select(F.col("name").alias("key"))
    return trigram_topk(names, fx.catalog(spark, d, with_embedding=False)).select("key", "rank", "id", "score")


@query
def word_similarity(spark, d):
    """Similarity of every distinct line name to its own part's catalog name."""
    li = fx.table(spark, d, "lineitem").select("l_partkey", "l_linenumber")
    part = fx.table(spark, d, "part")
    pairs = li.join(part, li.l_partkey == part.p_partkey).select(
        fx.line_variant().alias("q"), fx.catalog_name().alias("n")).distinct()
    return pairs.select("q", "n", search_ops.word_similarity_udf("q", "n").alias("score"))


@query
def vector_search(spark, d):
    """J2 + W2 + K1: every stored embedding as a query against the catalog vectors."""
    q = fx.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("qvec"))
    v = vector_topk(q, fx.catalog(spark, d))
    return v.select(F.col("key").cast("long").alias("vec_id"), "rank", "id", F.round("sim", 9).alias("sim"))


@query
def vector_search_lsh(spark, d):
    """J2, approximate: the same search through hash codes."""
    q = fx.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("qvec"))
    v = vector_topk_lsh(q, fx.catalog(spark, d))
    return v.select(F.col("key").cast("long").alias("vec_id"), "rank", "id", F.round("sim", 9).alias("sim"))


def _pairs(spark, d):
    return _line_names(spark, d).select("name", "qvec_id").distinct()


@query
def hybrid_search(spark, d):
    """J3 + J4 + T5 + K2: fused candidates of every distinct (name, query vector)."""
    return search_ops.hybrid_search(_pairs(spark, d), fx.catalog(spark, d), fx.query_vectors(spark, d))


@query
def hybrid_degraded(spark, d):
    """The same search when no query can be embedded (trigram ranks only)."""
    return search_ops.hybrid_search(_pairs(spark, d), fx.catalog(spark, d), None)


def _by_list(spark, d, decide):
    """Decisions of every search pair: made once for the pairs that share a name and its candidates."""
    lists, members = search_ops.candidate_lists(_pairs(spark, d), fx.catalog(spark, d), fx.query_vectors(spark, d))
    return search_ops.expand_lists(decide(lists), members)


@query
def obvious_match(spark, d):
    """R1 + W7: best, second and the obvious-match decision per search pair."""
    return _by_list(spark, d, lambda c: search_ops.obvious(c, route_ops.PAIR))


@query
def rerank(spark, d):
    """Default rule reranker over every search pair's candidates."""
    return _by_list(spark, d, lambda c: rr_ops.rule_rerank(c, route_ops.PAIR))


@query
def route_lines(spark, d):
    """Route of every search pair: offers are looked for where no candidate is chosen, and counted."""
    pairs = cut_files(_pairs(spark, d))
    lists, members = search_ops.candidate_lists(pairs, fx.catalog(spark, d), fx.query_vectors(spark, d))
    find = lambda need: off_ops.find_offers(need, fx.shopping(spark, d), fx.organic(spark, d))
    routes, _ = route_ops.route_pairs(cut_files(lists), pairs=pairs, members=members, find=find)
    return routes.drop("offer_error")


@query
def match_pipeline(spark, d):
    """Every order line matched, routed and priced, or queued for a person."""
    out = route_ops.match_lines(fx.lines(spark, d), fx.catalog(spark, d), fx.query_vectors(spark, d),
                                fx.shopping(spark, d), fx.organic(spark, d))
    return out["lines"].drop("cache_key")


@query
def dedupe_fanout(spark, d):
    """J8 + W3: donor line and cached flag of every order line."""
    return route_ops.first_occurrence(fx.lines(spark, d)).select("session_id", "line_index", "cache_key", "donor_index", "cached")


@query
def verdict_check(spark, d):
    """J5 + T8 + T10: stored verdicts checked against the candidates asked about."""
    cands = fx.question_candidates(spark, d).where(F.col("id").isNotNull())
    return rr_ops.verdicts_from_responses(fx.rerank_responses(spark, d), cands, ["session_id", "line_index"])


@query
def candidate_block(spark, d):
    """The candidate list text of every catalog question."""
    c = fx.question_candidates(spark, d).where(F.col("id").isNotNull()).withColumnRenamed("name", "name_c")
    return route_ops.candidate_block(c, ["session_id", "line_index"])


@query
def review_queue(spark, d):
    """R5 + A8 + K5 + T16: questions with their candidates, suggestion first."""
    pend = fx.questions(spark, d).select("session_id", "line_index", "reason", F.when(
        F.col("reason") == "ambiguous", (F.col("user_id") * 8 + (F.col("line_index") * 3) % 8).cast("string")).alias("suggested_id"),
        F.lit("r").alias("verdict_reason"))
    r = route_ops.review_queue(pend, fx.question_candidates(spark, d))
    return r.select("session_id", "line_index", "reason", "suggested_id",
                    F.array_join(F.transform("candidates", lambda x: F.coalesce(x["id"], x["name"])), ",").alias("candidate_order"),
                    "n_candidates")


@query
def quote_pipeline(spark, d):
    """R6 + R4 + J8 + A1: every order line matched; stand-in answers to the pipeline's own questions (the suggestion, the
    first offer, a skip or nothing, by line number); repeats follow; totals per session."""
    out = route_ops.match_lines(fx.lines(spark, d), fx.catalog(spark, d), fx.query_vectors(spark, d),
                                fx.shopping(spark, d), fx.organic(spark, d))
    asked = F.lit("2024-01-01 00:00:00").cast("timestamp")
    pend = cut_files(route_ops.pending_questions(out["lines"]).withColumn("asked_at", asked))
    shown = cut_files(route_ops.question_candidates(pend, out["candidates"], out["offers"]))
    first = shown.groupBy("session_id", "line_index").agg(F.min_by("url", "rank").alias("url"))
    k = F.col("line_index") % 4
    kind = F.when(k == 0, F.lit("skip")).when(k < 3, F.when(F.col("reason") == "ambiguous", F.lit("product")).otherwise(F.lit("internet")))
    choices = (pend.join(first, ["session_id", "line_index"], "left").withColumn("type", kind).where(F.col("type").isNotNull())
               .select("session_id", "line_index", "type", F.when(F.col("type") == "product", F.col("suggested_id")).alias("id"),
                       F.when(F.col("type") == "internet", F.col("url")).alias("url"), F.col("asked_at").alias("at"), F.lit(1).cast("long").alias("event_id")))
    results = route_ops.close_lines(out["lines"], route_ops.apply_choices(pend, choices, shown))
    return quote.quotation_total(results)


@query
def offers_structured(spark, d):
    """E5 + W4 + K6 + T17 + T18: structured offers of every searched text."""
    return off_ops.offers_structured(fx.shopping(spark, d)).drop("origin")


@query
def offers_from_text(spark, d):
    """E6 + K7: offers read from the organic snippets of every searched text."""
    return off_ops.offers_from_text(fx.organic(spark, d)).drop("origin")


@query
def find_offers(spark, d):
    """Structured first, organic only for texts without structured offers."""
    q = fx.organic(spark, d).select("query").distinct()
    return off_ops.find_offers(q, fx.shopping(spark, d), fx.organic(spark, d))


@query
def snippet_block(spark, d):
    """Numbered snippet block of the first 8 organic results."""
    return off_ops.snippet_block(fx.organic(spark, d))


@query
def offer_requests(spark, d):
    """Provider search texts of every extracted line name."""
    n = _line_names(spark, d).select("session_id", "line_index", "name")
    return off_ops.offer_requests(n)


def _failing_provider(texts):
    """A provider that refuses some lines, as a remote model does."""
    if any("gizmo" in t.lower() for t in texts):
        raise RuntimeError("provider failed")
    return texts


@query
def error_rows(spark, d):
    """Lines whose provider call raises (texts with 'gizmo') become error rows; their neighbours go on."""
    called = prov.call_provider(fx.lines(spark, d).select("session_id", "line_index", "raw_text"), "raw_text", _failing_provider)
    return prov.error_results(called).select("session_id", "line_index", "source", "error")


@query
def offers_from_responses(spark, d):
    """E6 + T8 + K7 + T7: offers in stored model answers, one answer per searched text."""
    return off_ops.offers_from_responses(fx.offer_responses(spark, d)).drop("origin")


@query
def first_choice(spark, d):
    """W6 + X2: the winning answer of every question."""
    return route_ops.first_choice(fx.questions(spark, d), fx.choices(spark, d)).select(
        "session_id", "line_index", "type", "id", "url", "at")


@query
def apply_choices(spark, d):
    """R4 + J6 + J7 + X1: every question closed by its answer or by the timeout."""
    return route_ops.apply_choices(fx.questions(spark, d), fx.choices(spark, d), fx.question_candidates(spark, d))


@query
def choice_timeout(spark, d):
    """X1 (batch twin): questions not answered within 5 minutes."""
    r = route_ops.apply_choices(fx.questions(spark, d), fx.choices(spark, d), fx.question_candidates(spark, d))
    return r.where(F.col("reason") == "input_timeout").select("session_id", "line_index", "source", "reason")


@query
def cancel_session(spark, d):
    """Questions cancelled and lines dropped by the earliest cancel of a session."""
    q = fx.questions(spark, d)
    ln = fx.events_lines(spark, d)
    return route_ops.cancel_session(q, fx.choices(spark, d), ln)


@query
def apply_edits(spark, d):
    """Manual edits applied to every result row."""
    r = fx.results(spark, d).select("session_id", "line_index", "source", "qty", "unit", "name",
                                    F.col("product.name").alias("product_name"), "price", "margin")
    return route_ops.apply_edits(r, fx.edits(spark, d))


@query
def validate_requests(spark, d):
    """Start requests need a session id and a line list."""
    return ses_ops.validate_requests(fx.requests(spark, d)).select("o_orderkey", "session_id", "n_lines", "error")


@query
def embedding_todo(spark, d):
    """Catalog rows without a vector, with the text to embed."""
    return emb_ops.embedding_todo(fx.catalog(spark, d))


@query
def embed_backfill(spark, d):
    """Vectors for every row without one (offline hashed-trigram provider, 64 dims)."""
    todo = emb_ops.embedding_todo(fx.catalog(spark, d))
    return emb_ops.embed_texts(todo, emb_ops.hashed_trigram_provider(64))


@query
def reembed_worklist(spark, d):
    """C4: rows to re-embed after the catalog changes."""
    return emb_ops.reembed_worklist(_applied(spark, d)["snapshot"])


@query
def apply_embeddings(spark, d):
    """Backfilled vectors written back; rows that had a vector keep it (its first number), every vector has length 1."""
    cat = fx.catalog(spark, d)
    new = emb_ops.embed_texts(emb_ops.embedding_todo(cat), emb_ops.hashed_trigram_provider(64))
    out = emb_ops.apply_embeddings(cat, new).join(cat.select("id", F.col("embedding").isNotNull().alias("had")), "id")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.select("id", F.size("embedding").alias("dims"), F.round(norm, 4).alias("norm"),
                      F.when(F.col("had"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6)).alias("kept_first"))


# ---------------------------------------------------------------- sessions

from penawar.operators import sessions as ses_ops  # noqa: E402


@query
def session_members(spark, d):
    """Participants per session from join / leave events."""
    return ses_ops.session_members(fx.members(spark, d))


@query
def last_leaver(spark, d):
    """W8 + X5: when the last participant of each session left."""
    return ses_ops.last_leaver(fx.members(spark, d))


@query
def duplicate_start(spark, d):
    """Starts of a running session are rejected (every event of a user starts a run of 100 x ``value`` minutes)."""
    ev = fx.table(spark, d, "events")
    mins = F.coalesce(F.col("value").cast("int"), F.lit(0)) * 100
    starts = ev.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("start_id"),
                       F.col("ts").alias("start_at"), (F.col("ts") + F.make_dt_interval(mins=mins)).alias("end_at"))
    return ses_ops.duplicate_start(starts)


@query
def extract_responses(spark, d):
    """E1 + T8 + T9: name, qty and unit from stored model answers (unreadable -> whole line)."""
    from penawar.operators.extract import extract_from_responses

    out = extract_from_responses(fx.lines(spark, d), fx.extraction_responses(spark, d), ["session_id", "line_index"])
    return out.select("session_id", "line_index", "name", "qty", "unit")


@query
def similarity_percent(spark, d):
    """The similarity shown to a person for every trigram candidate."""
    names = _line_names(spark, d).select(F.col("name").alias("key"))
    t = trigram_topk(names, fx.catalog(spark, d, with_embedding=False))
    return t.select("key", "rank", "id", F.round(F.col("score") * 100).cast("int").alias("score_pct"))


# ---------------------------------------------------------------- the matching core over part texts


def _part_candidates(spark, d):
    return search_ops.hybrid_search(fx.part_texts(spark, d), fx.catalog(spark, d), fx.query_vectors(spark, d))


@query
def parts_trigram(spark, d):
    """P2 + J1 + W1 + K1: top-8 catalog rows per part text by word_similarity >= 0.3."""
    names = fx.part_texts(spark, d).select(F.col("name").alias("key"))
    return trigram_topk(names, fx.catalog(spark, d, with_embedding=False)).select("key", "rank", "id", F.round("score", 12).alias("score"))


@query
def parts_hybrid(spark, d):
    """J3 + J4 + T5 + K2: fused candidates of every part text and its vector."""
    c = _part_candidates(spark, d)
    return c.select("name", "qvec_id", "rank", "id", "name_c", "brand", "category", "price", "unit",
                    *[F.round(x, 9).alias(x) for x in ("score", "vector_sim", "rrf")])


@query
def parts_degraded(spark, d):
    """The same without query vectors."""
    c = search_ops.hybrid_search(fx.part_texts(spark, d), fx.catalog(spark, d), None)
    return c.select("name", "qvec_id", "rank", "id", F.round("score", 9).alias("score"), F.round("rrf", 9).alias("rrf"))


@query
def parts_obvious(spark, d):
    """R1 + W7: the obvious-match decision per part text."""
    o = search_ops.obvious(cut_files(_part_candidates(spark, d)), route_ops.PAIR)
    return o.select("name", "qvec_id", "best_id", "n_candidates", "obvious",
                    *[F.round(x, 9).alias(x) for x in ("best_score", "second_score", "gap")])


@query
def parts_rerank(spark, d):
    """The rule reranker over the candidates of every part text."""
    r = rr_ops.rule_rerank(cut_files(_part_candidates(spark, d)), route_ops.PAIR)
    return r.select("name", "qvec_id", "id", F.round("confidence", 9).alias("confidence"), "reason")


@query
def parts_route(spark, d):
    """The route of every part text with candidates."""
    r = route_ops.route_pairs(cut_files(_part_candidates(spark, d)))
    return r.withColumn("confidence", F.round("confidence", 9))


@query
def parts_percent(spark, d):
    """The similarity shown to a person for the candidates of every part text."""
    names = fx.part_texts(spark, d).select(F.col("name").alias("key"))
    t = trigram_topk(names, fx.catalog(spark, d, with_embedding=False))
    return t.select("key", "rank", "id", F.round(F.col("score") * 100).cast("int").alias("score_pct"))
