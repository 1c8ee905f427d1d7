"""Routing, answers and results.

The source system handles one line at a time and parks a promise while a person
answers. Here the pause is data: the pipeline emits RESULTS for lines it can
close and PENDING questions for the rest; answers arrive later as CHOICES and
``apply_choices`` closes those rows. No executor ever waits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penawar.config import DEFAULT, MatchConfig
from penawar.functions import text as tx
from penawar.operators import offers as off
from penawar.operators.cells import small
from penawar.operators.extract import extract_rules
from penawar.operators.rerank import rule_rerank
from penawar.operators.search import candidate_lists, expand_lists, hybrid_search, obvious
from penawar.session import cut_files, cut_lineage

PAIR = ["name", "qvec_id"]

Extractor = Callable[[DataFrame], DataFrame]
Reranker = Callable[[DataFrame, list[str]], DataFrame]
Finder = Callable[[DataFrame], DataFrame]


def first_occurrence(lines: DataFrame) -> DataFrame:
    """Per session, the first line with the same normalised text is the
    donor; later ones reuse its result (``cached``).

    The donor is a ``min`` aggregate (combined map-side) joined back, not a window,
    so one text repeated across a huge session never lands whole in one task. Only
    texts that a session repeats are joined back: any other line is its own donor."""
    keyed = tx.once(lines.withColumn("cache_key", tx.normalise_key("raw_text")), "cache_key")
    keyed = keyed.where(F.col("session_id").isNotNull() & F.col("cache_key").isNotNull())
    repeats = (keyed.groupBy("session_id", "cache_key").agg(F.min("line_index").alias("_first"), F.count(F.lit(1)).alias("_n"))
               .where(F.col("_n") > 1).drop("_n").withColumn("_repeated", F.lit(True)))
    first = F.when(F.col("_repeated"), F.col("_first")).otherwise(F.col("line_index"))
    return (keyed.join(small(cut_files(repeats)), ["session_id", "cache_key"], "left").withColumn("donor_index", first)
            .select("session_id", "cache_key", *[c for c in lines.columns if c != "session_id"], "donor_index")
            .withColumn("cached", F.col("line_index") > F.col("donor_index")))


def decide_pairs(cands: DataFrame, cfg: MatchConfig = DEFAULT, rerank=rule_rerank) -> DataFrame:
    """R1 + R2 per search pair with candidates: (name, qvec_id, route, product_id, confidence, verdict_reason,
    suggested_id, n_candidates, rerank_error)."""
    ob = obvious(cands, PAIR, cfg)
    open_pairs = ob.where(~F.col("obvious")).select(*PAIR)
    verdict = rerank(cands.join(open_pairs, PAIR, "left_semi"), PAIR)
    if "error" not in verdict.columns:
        verdict = verdict.withColumn("error", F.lit(None).cast("string"))
    r = ob.join(verdict, PAIR, "left")
    route = (F.when(F.col("obvious"), F.lit("auto_database"))
             .when(F.col("id").isNotNull() & (F.col("confidence") >= cfg.rerank_auto_confidence), F.lit("auto_database_ai"))
             .when(F.col("id").isNull(), F.lit("offers"))
             .otherwise(F.lit("ask")))
    r = r.select(*PAIR, route.alias("route"),
                 F.when(F.col("obvious"), F.col("best_id")).when(route == "auto_database_ai", F.col("id")).alias("product_id"),
                 F.when(route == "auto_database_ai", F.col("confidence")).alias("confidence"),
                 F.when(~F.col("obvious"), F.col("reason")).alias("verdict_reason"),
                 F.when(route == "ask", F.col("id")).alias("suggested_id"),
                 "n_candidates", F.when(~F.col("obvious"), F.col("error")).alias("rerank_error"))
    return r


def route_pairs(cands: DataFrame, cfg: MatchConfig = DEFAULT, rerank=rule_rerank, pairs: DataFrame | None = None,
                members: DataFrame | None = None, find: Finder | None = None):
    """R1-R3 per search pair.

    ``cands``: candidates of every pair, or of every list of candidates that the pairs of ``members`` share
    (``search.candidate_lists``). Without ``find`` this is R1 and R2 for the pairs with candidates (``decide_pairs``).
    With ``find`` and ``pairs`` it is the whole routing of all ``pairs``: those without candidates, and those for which
    the reranker chose none, look for offers. Returns (routes, offers); routes have the columns of ``decide_pairs`` plus
    n_offers, offer_error, ``source`` (what closes the line: the catalog match, ``not_found`` without offers; null if a
    person is asked) and ``reason`` (why one is: ``ambiguous`` or ``internet_fallback``)."""
    decided = decide_pairs(cands, cfg, rerank)
    if members is not None:
        decided = expand_lists(decided, members)
    if find is None:
        return decided
    d = decided.withColumnsRenamed({c: f"_{c}" for c in PAIR})
    # a reranker's calls are made once
    routed = cut_files(pairs.join(d, _same_pair(pairs, d), "left").drop(*[f"_{c}" for c in PAIR]).fillna({"route": "offers", "n_candidates": 0}))
    need = routed.where((F.col("route") == "offers") & F.col("rerank_error").isNull()).select(F.col("name").alias("query")).distinct()
    offers = find(need)
    if "error" in offers.columns:
        offers = cut_lineage(offers)
        n_off = offers.groupBy("query").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("n_offers"), F.max("error").alias("offer_error"))
        offers = offers.where(F.col("error").isNull()).drop("error")
    else:
        offers = cut_files(offers)  # counted for every text, shown with the questions
        n_off = offers.groupBy("query").agg(F.count(F.lit(1)).alias("n_offers"), F.lit(None).cast("string").alias("offer_error"))
    routed = routed.join(n_off, routed.name == n_off.query, "left").drop("query").fillna({"n_offers": 0})
    source = F.when(F.col("route").isin("auto_database", "auto_database_ai"), F.col("route")) \
        .when((F.col("route") == "offers") & (F.col("n_offers") == 0), F.lit("not_found"))
    reason = F.when(F.col("route") == "ask", F.lit("ambiguous")).when(
        (F.col("route") == "offers") & (F.col("n_offers") > 0), F.lit("internet_fallback"))
    return routed.withColumn("source", source).withColumn("reason", reason), offers


def _same_pair(a: DataFrame, b: DataFrame) -> F.Column:
    """Rows of ``a`` and of ``b`` (with underscored names) for one pair, which may have no query vector."""
    return (a["name"] == b["_name"]) & a["qvec_id"].eqNullSafe(b["_qvec_id"])


PRODUCT = "struct<id:string,name:string,brand:string,category:string,price:double,unit:string,supplier:string,url:string>"


def _product(**fields) -> F.Column:
    names = [x.split(":")[0] for x in PRODUCT[len("struct<"):-1].split(",")]
    kinds = dict(x.split(":") for x in PRODUCT[len("struct<"):-1].split(","))
    return F.struct(*[fields.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names])


def match_lines(lines: DataFrame, catalog: DataFrame, query_vectors: DataFrame | None,
                shopping: DataFrame | None, organic: DataFrame | None, cfg: MatchConfig = DEFAULT,
                extract: Extractor | None = None, rerank: Reranker = rule_rerank, find: Finder | None = None) -> dict[str, DataFrame]:
    """The whole run for any number of lists at once.

    Each step may be a provider whose calls can fail for some rows (E8): ``extract`` adds name, qty, unit and optionally
    ``error`` to lines, ``rerank`` gives verdicts on candidates, optionally with ``error``, ``find`` gives offers for queries,
    optionally with ``error`` (default: the tables ``shopping`` and ``organic``), and ``query_vectors`` may lack vectors
    (those searches keep the trigram ranks). A line whose call failed becomes an ``error`` result; the others go on.
    Lines that repeat a failed one are called themselves, and the first that succeeds serves those after it (J8).

    Returns ``lines`` (RESULTS of every non-blank line; a pending question has no source yet),
    ``candidates`` (hybrid top-k per search pair) and ``offers``.
    """
    ls = first_occurrence(lines.where(tx.js_trim("raw_text") != ""))  # P5: blank lines skipped, indices kept
    # the rules are read with the lines, so that the donors need no files of their own
    ls = cut_files(ls if extract else extract_rules(ls, cfg=cfg))
    steps = (catalog, query_vectors, find or (lambda need: off.find_offers(need, shopping, organic, cfg)), cfg, extract, rerank)
    out, cands, offers = _called(ls.where(~F.col("cached")), *steps)
    failed = out.where(F.col("source") == "error").select("session_id", "cache_key")
    again = ls.where(F.col("cached")).join(failed, ["session_id", "cache_key"], "left_semi")
    if extract is None and rerank is rule_rerank and find is None or not again.limit(1).count():
        return {"lines": out.unionByName(_copies(ls, out)), "candidates": cands, "offers": offers}
    out2, cands2, offers2 = _called(again, *steps)
    # of a failed text's lines the first that succeeds is the donor of those after it
    kept = out2.join(out2.where(F.col("source").isNull() | (F.col("source") != "error")).groupBy("session_id", "cache_key")
                     .agg(F.min("line_index").alias("_first")), ["session_id", "cache_key"], "left")
    own = cut_lineage(kept.where(F.col("_first").isNull() | (F.col("line_index") <= F.col("_first"))).drop("_first"))
    served = _copies(ls.join(own.select("session_id", "line_index").withColumn("_own", F.lit(True)), ["session_id", "line_index"], "left")
                     .where("_own is null").drop("_own"), out.unionByName(own).where(F.col("source").isNull() | (F.col("source") != "error")))
    return {"lines": out.unionByName(own).unionByName(served), "candidates": cands.unionByName(cands2).dropDuplicates([*PAIR, "id"]),
            "offers": offers.unionByName(offers2).dropDuplicates(["query", "pos"])}


def _called(rows: DataFrame, catalog, query_vectors, find, cfg, extract, rerank) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, candidates, offers) of lines that are each called on their own; they have been read where there is no ``extract``."""
    donors = cut_files(extract(rows)) if extract else rows
    if "error" not in donors.columns:
        donors = donors.withColumn("error", F.lit(None).cast("string"))
    pairs = cut_files(donors.where(F.col("error").isNull()).select(*PAIR).distinct())
    # candidates feed routing, reranking and the review queue: written once
    if rerank is rule_rerank:  # pairs that share a name and its candidates share the decision
        lists, members = candidate_lists(pairs, catalog, query_vectors, cfg)
        lists = cut_files(lists)
        cands = expand_lists(lists, members)
        routed, offers = route_pairs(lists, cfg, pairs=pairs, members=members, find=find)
    else:  # a reranker is called for every pair
        cands = cut_files(hybrid_search(pairs, catalog, query_vectors, cfg))
        routed, offers = route_pairs(cands, cfg, rerank, pairs=pairs, find=find)
    routed = _with_products(routed, catalog).withColumnsRenamed({c: f"_{c}" for c in PAIR})
    out = donors.join(routed, _same_pair(donors, routed), "left").drop(*[f"_{c}" for c in PAIR])
    out = out.withColumn("error", F.coalesce("error", "rerank_error", "offer_error"))
    failed = F.col("error").isNotNull()
    closed = F.col("source").isNotNull() & ~failed
    out = out.select("session_id", "line_index", "raw_text", "cache_key", "name", "qvec_id", "qty", "unit",
                     F.when(failed, F.lit("error")).otherwise(F.col("source")).alias("source"), F.when(~failed, F.col("reason")).alias("reason"),
                     F.when(~failed, F.col("product_id")).alias("product_id"),
                     F.when(closed, F.col("product")).alias("product"), F.when(closed, F.col("product.price")).alias("price"),
                     "confidence", "verdict_reason", "suggested_id", "n_candidates", "n_offers", "error",
                     F.lit(None).cast("double").alias("margin"), F.lit(False).alias("cached"))
    return cut_files(out), cands, offers  # results: read for themselves and for their copies


def _with_products(routed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Routed pairs with the ``product`` they chose. The pairs are joined, before there is a row per line, and only those
    that chose one: a null product_id would gather all others in one task."""
    cat = catalog.select(F.col("id").cast("string").alias("product_id"),
                         _product(id=F.col("id"), name=F.col("name"), brand=F.col("brand"), category=F.col("category"),
                                  price=F.col("price"), unit=F.col("unit")).alias("product"))
    chosen = routed.where(F.col("product_id").isNotNull()).join(cat, "product_id", "left")
    return chosen.unionByName(routed.where(F.col("product_id").isNull()), allowMissingColumns=True)


def _copies(keyed: DataFrame, donors: DataFrame) -> DataFrame:
    """Lines that repeat a donor's text take its result, or its error where it can't be tried again."""
    dups = small(keyed.where(F.col("cached")).select("session_id", "line_index", "raw_text", "cache_key"))
    view = donors.drop("raw_text", "cached", "line_index")
    return dups.join(view, ["session_id", "cache_key"]).withColumn("cached", F.coalesce(F.col("source"), F.lit("")) != "error")


def pending_questions(lines: DataFrame) -> DataFrame:
    """The lines of ``match_lines`` that wait for a person: one question per donor, none for its copies."""
    return (lines.where(F.col("source").isNull() & F.col("reason").isNotNull() & ~F.col("cached"))
            .select("session_id", "line_index", *PAIR, "reason", "suggested_id", "verdict_reason"))


def question_candidates(pending: DataFrame, cands: DataFrame, offers: DataFrame) -> DataFrame:
    """What each question shows: catalog candidates by rank, or offers by position. (session_id, line_index, rank, id,
    name, brand, category, price, unit, score, supplier, url, title)"""
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    a = pending.where(F.col("reason") == "ambiguous").join(cands, PAIR).select(
        "session_id", "line_index", F.col("rank").cast("long").alias("rank"), "id", F.col("name_c").alias("name"), "brand", "category", "price", "unit",
        "score", null("string", "supplier"), null("string", "url"), null("string", "title"))
    i = pending.where(F.col("reason") == "internet_fallback").join(offers, pending.name == offers.query).select(
        "session_id", "line_index", F.col("pos").cast("long").alias("rank"), null("string", "id"), null("string", "name"),
        null("string", "brand"), null("string", "category"), "price", null("string", "unit"), null("double", "score"), "supplier", "url", "title")
    return a.unionByName(i)


def review_queue(pending: DataFrame, shown: DataFrame) -> DataFrame:
    """One question per line with its candidates packed in order — the suggested candidate first, then by
    rank. ``shown``: rows of ``question_candidates`` (the score may be left out)."""
    order = F.when(F.col("id") == F.col("suggested_id"), 0).otherwise(1)
    pct = F.round(F.col("score") * 100).cast("int") if "score" in shown.columns else F.lit(None).cast("int")
    x = pending.join(shown.withColumn("label", F.coalesce("name", "title")).drop("name"), ["session_id", "line_index"])
    keys = ["session_id", "line_index", "reason", "suggested_id", "verdict_reason"]
    x = x.select(*keys, F.struct(order.alias("o"), F.col("rank").alias("r"), "id", F.col("label").alias("name"), "brand", "category",
                                 "price", pct.alias("score_pct"), "supplier", "url").alias("c"))
    g = x.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return g.select(*keys, F.transform("cs", lambda c: c.dropFields("o", "r")).alias("candidates"), F.size("cs").alias("n_candidates"))


def close_lines(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """RESULTS: pending donors of ``match_lines`` take their answer (rows of ``apply_choices``), then the lines that
    repeat them take the answered result. Lines that repeat a cancelled one are dropped: the session is over."""
    a = answers.select("session_id", "line_index", F.col("product_id").alias("_id"), F.col("source").alias("_s"), F.col("reason").alias("_r"), F.col("price").alias("_p"),
                       F.when(F.coalesce("product_id", "product_name", "product_supplier", "product_url").isNotNull(),
                              _product(id=F.col("product_id"), name=F.col("product_name"), price=F.when(F.col("product_id").isNotNull(), F.col("price")),
                                       supplier=F.col("product_supplier"), url=F.col("product_url"))).alias("_product"))
    donors = lines.where(~F.col("cached")).join(a, ["session_id", "line_index"], "left")
    waiting = F.col("source").isNull() & F.col("_s").isNotNull()
    donors = donors.select(*[c for c in lines.columns if c not in ("source", "reason", "price", "product", "product_id", "margin")],
                           F.when(waiting, F.col("_id")).otherwise(F.col("product_id")).alias("product_id"),
                           F.when(waiting, F.col("_product")).otherwise(F.col("product")).alias("product"),
                           F.when(waiting, F.col("_p")).otherwise(F.col("price")).alias("price"),
                           F.when(waiting, F.col("_r")).otherwise(F.col("reason")).alias("reason"),
                           F.when(waiting & (F.col("_s") == "user_selected_internet"), F.lit(0.0)).otherwise(F.col("margin")).alias("margin"),
                           F.when(waiting, F.col("_s")).otherwise(F.col("source")).alias("source"))
    donors = cut_files(donors)
    dups = lines.where(F.col("cached")).select("session_id", "line_index", "raw_text", "cache_key")
    view = donors.where(F.col("source").isNull() | ~F.col("source").isin("cancelled", "error")).drop("raw_text", "cached", "line_index")
    copies = dups.join(view, ["session_id", "cache_key"]).withColumn("cached", F.lit(True))
    return donors.unionByName(copies)


def candidate_block(cands: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate list as text: ``- id=… | name[ | brand: …][ | category: …]`` per line."""
    line = F.concat(F.lit("- id="), F.col("id"), F.lit(" | "), F.col("name_c"),
                    F.when(F.col("brand") != "", F.concat(F.lit(" | brand: "), F.col("brand"))).otherwise(F.lit("")),
                    F.when(F.col("category") != "", F.concat(F.lit(" | category: "), F.col("category"))).otherwise(F.lit("")))
    g = cands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("ls"))
    return g.select(*keys, F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("block"))


# ----------------------------------------------------------------- answers


def first_choice(questions: DataFrame, choices: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """The first answer that arrives while the question is pending
    (at or after it was asked and before the timeout) wins; the rest are dropped.
    ``min_by`` is an aggregate, so many answers to one question combine map-side."""
    q = questions.select("session_id", "line_index", "asked_at")
    c = choices.join(q, ["session_id", "line_index"])
    live = c.where((F.col("at") >= F.col("asked_at"))
                   & (F.col("at") < F.col("asked_at") + F.expr(f"INTERVAL {cfg.ask_timeout_minutes} MINUTES")))
    cols = [x for x in choices.columns if x not in ("session_id", "line_index")]
    first = live.groupBy("session_id", "line_index").agg(
        F.min_by(F.struct(*cols), F.struct("at", "event_id")).alias("c"))
    return first.select("session_id", "line_index", "c.*")


def _first_k(df: DataFrame, w) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def apply_choices(questions: DataFrame, choices: DataFrame, candidates: DataFrame,
                  cfg: MatchConfig = DEFAULT) -> DataFrame:
    """R4 + J6 + J7 + X1: every question closed by its first live answer, or by
    the timeout (``skipped`` / ``input_timeout``).

    product -> candidate with that id (as text), else null product, same source;
    internet -> first offer with that url; cancel -> cancelled; skip -> skipped;
    anything else -> unknown.
    """
    fc = first_choice(questions, choices, cfg)
    base = questions.join(fc, ["session_id", "line_index"], "left")
    db = candidates.where(F.col("id").isNotNull()).select(
        F.col("session_id").alias("_s1"), F.col("line_index").alias("_l1"), F.col("id").alias("_cid"),
        F.col("name").alias("c_name"), F.col("price").alias("c_price"))
    # offers have no id; one without a url is found by an answer without one
    net = candidates.where(F.col("id").isNull())
    wn = Window.partitionBy("session_id", "line_index", "url").orderBy("rank")
    net = _first_k(net, wn).select(F.col("session_id").alias("_s2"), F.col("line_index").alias("_l2"),
                                   F.col("url").alias("_curl"), F.col("title").alias("o_title"), F.lit(True).alias("_hit"),
                                   F.col("supplier").alias("o_supplier"), F.col("price").alias("o_price"))
    x = base.join(db, (F.col("session_id") == F.col("_s1")) & (F.col("line_index") == F.col("_l1"))
                  & (F.col("type") == "product") & (F.col("id") == F.col("_cid")), "left")
    x = x.join(net, (F.col("session_id") == F.col("_s2")) & (F.col("line_index") == F.col("_l2"))
               & (F.col("type") == "internet") & F.col("url").eqNullSafe(F.col("_curl")), "left")
    t = F.col("type")
    source = (F.when(t.isNull(), F.lit("skipped")).when(t == "cancel", F.lit("cancelled")).when(t == "skip", F.lit("skipped"))
              .when(t == "product", F.lit("user_selected_db")).when(t == "internet", F.lit("user_selected_internet"))
              .otherwise(F.lit("unknown")))
    product_name = F.when(t == "product", F.col("c_name")).when(
        (t == "internet") & F.col("_hit"), F.coalesce(F.when(F.col("o_title") != "", F.col("o_title")), F.col("name")))
    return x.select(
        "session_id", "line_index", "name", source.alias("source"),
        F.when(t == "product", F.col("_cid")).alias("product_id"),
        product_name.alias("product_name"),
        F.when((t == "internet") & F.col("_hit"), F.col("o_supplier")).alias("product_supplier"),
        F.when((t == "internet") & F.col("_hit"), F.col("_curl")).alias("product_url"),
        F.when(t == "product", F.col("c_price")).when(t == "internet", F.col("o_price")).alias("price"),
        F.when(t.isNull(), F.lit("input_timeout")).alias("reason"),
    )


def cancel_session(questions: DataFrame, choices: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """The earliest cancel of a session closes its pending questions as
    ``cancelled`` (a question raised at or after the cancel too) and drops the
    lines started after it. A question answered before is ``answered``, one that
    timed out before stays ``open`` here. Returns (session_id, line_index, state, kind)."""
    when = F.struct("at", "event_id")
    cancels = choices.where(F.col("type") == "cancel").groupBy("session_id").agg(F.min(when).alias("cancel"))
    answered = first_choice(questions, choices, cfg).select("session_id", "line_index", when.alias("answer"))
    q = questions.join(cancels, "session_id", "left").join(answered, ["session_id", "line_index"], "left")
    cancel_at = F.col("cancel.at")
    state = (F.when(F.col("answer").isNotNull() & (F.col("cancel").isNull() | (F.col("answer") < F.col("cancel"))), F.lit("answered"))
             .when(F.col("cancel").isNull(), F.lit("open"))
             .when(F.col("asked_at") >= cancel_at, F.lit("cancelled"))
             .when(cancel_at < F.col("asked_at") + F.expr(f"INTERVAL {cfg.ask_timeout_minutes} MINUTES"),
                   F.lit("cancelled"))
             .otherwise(F.lit("open")))
    qs = q.select("session_id", "line_index", state.alias("state"))
    ln = lines.join(cancels, "session_id", "left").select(
        "session_id", "line_index",
        F.when(cancel_at.isNotNull() & (F.col("started_at") > cancel_at), F.lit("dropped"))
        .otherwise(F.lit("kept")).alias("state"))
    return qs.withColumn("kind", F.lit("question")).unionByName(ln.withColumn("kind", F.lit("line")))


def apply_edits(results: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual edits (qty, unit, name, product name, price, margin) override
    result values; ``price_set_null`` clears a price; a product name typed on a
    row without product creates one. Numbers typed go through T13."""
    e = edits.select("session_id", "line_index",
                     F.when(F.col("qty_text").isNotNull(), tx.edited_number("qty_text")).alias("e_qty"),
                     F.when(F.col("unit_text").isNotNull(), tx.js_trim("unit_text")).alias("e_unit"),
                     F.when(F.col("name_text").isNotNull(), tx.js_trim("name_text")).alias("e_name"),
                     F.when(F.col("product_text").isNotNull(), tx.js_trim("product_text")).alias("e_product"),
                     F.when(F.col("price_text").isNotNull() & (tx.js_trim("price_text") != ""),
                            tx.edited_number("price_text")).alias("e_price"),
                     (F.col("price_text").isNotNull() & (tx.js_trim("price_text") == "")).alias("price_set_null"),
                     F.when(F.col("margin_text").isNotNull(), tx.edited_number("margin_text")).alias("e_margin"))
    x = results.join(e, ["session_id", "line_index"], "left")
    return x.select(
        "session_id", "line_index", "source",
        F.coalesce("e_qty", "qty").alias("qty"), F.coalesce("e_unit", "unit").alias("unit"),
        F.coalesce("e_name", "name").alias("name"),
        F.coalesce("e_product", "product_name").alias("product_name"),
        F.when(F.col("price_set_null") == True, F.lit(None)).otherwise(F.coalesce("e_price", "price")).alias("price"),  # noqa: E712
        F.when(F.col("source") == "user_selected_internet", F.coalesce("e_margin", "margin", F.lit(0.0))).alias("margin"),
    )


def edit_results(results: DataFrame, edits: DataFrame) -> DataFrame:
    """R7 on RESULTS rows: the edited values replace the row's own, so totals, sheet and export follow them. A product
    name typed on a row without a product makes one."""
    e = apply_edits(results.withColumn("product_name", F.col("product.name")), edits)
    e = e.select("session_id", "line_index", *[F.col(c).alias(f"_{c}") for c in ("qty", "unit", "name", "product_name", "price", "margin")])
    x = results.join(e, ["session_id", "line_index"], "left")
    named = F.when(F.col("product").isNotNull(), F.col("product").withField("name", F.col("_product_name"))) \
        .when(F.col("_product_name").isNotNull(), _product(name=F.col("_product_name")))
    new = {"qty": F.col("_qty"), "unit": F.col("_unit"), "name": F.col("_name"), "price": F.col("_price"), "margin": F.col("_margin"), "product": named}
    return x.select(*[new[c].alias(c) if c in new else F.col(c) for c in results.columns])
