"""Answers, cancels, offers, results end to end, providers, catalog changes in order and sinks on inline cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from penawar.operators import catalog as cat_ops
from penawar.operators import offers as off
from penawar.operators import providers as prov
from penawar.operators import quote, sessions, sinks
from penawar.operators import route as route_ops
from penawar.operators.search import hybrid_search, rrf
from penawar.sources import lines as src_lines

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)
MIN = dt.timedelta(minutes=1)
CHOICE = "session_id string, line_index int, type string, id string, url string, at timestamp, event_id long"
SHOP = "query string, pos long, extracted_price double, price string, source string, title string, product_link string, link string"
ORG = "query string, pos long, title string, snippet string, link string"


def organic(spark, *snippets, link="https://toko.example/x"):
    return spark.createDataFrame([("q", i, f"t{i}", x, link) for i, x in enumerate(snippets)], ORG)


def test_cash_price_beside_an_instalment_counts(spark):
    got = off.offers_from_text(organic(spark, "Harga Rp 5.999.000 atau cicilan Rp 249.958/bln")).collect()
    assert [(r.price, r.supplier) for r in got] == [(5999000.0, "toko.example")]
    assert off.offers_from_text(organic(spark, "Cicilan Rp 249.958/bln untuk 24 bln")).count() == 0
    assert off.offers_from_text(organic(spark, "Rp 249.958 / bulan")).count() == 0
    got = off.offers_from_text(organic(spark, "Diskon dari Rp 9.000 jadi Rp 7.500", link="item")).collect()
    assert [(r.price, r.supplier) for r in got] == [(7500.0, "Unknown")]


def test_offers_in_stored_answers(spark):
    rows = [("a", '```json\n[{"supplier":"","price":"Rp 1.500"},{"supplier":"B","price":"x"},{"supplier":"C","price":"7","url":"u"}]\n```'),
            ("b", '{"supplier":"A","price":"5"}'), ("c", "nothing"), ("d", None), ("e", "[]")]
    got = off.offers_from_responses(spark.createDataFrame(rows, "query string, response string")).collect()
    assert sorted((r.query, r.pos, r.supplier, r.price, r.url) for r in got) == [("a", 0, "Unknown", 1500.0, None), ("a", 2, "C", 7.0, "u")]


def test_offer_cascade(spark):
    shop = spark.createDataFrame([("a", 1, 10.0, None, "S", "t", None, "l"), ("b", 1, 0.0, None, "S", "t", None, "l")], SHOP)
    org = spark.createDataFrame([("a", 1, "t", "Rp 5", "https://x.example/1"), ("b", 1, "t", "Rp 5", "https://x.example/1")], ORG)
    q = spark.createDataFrame([("a",), ("b",), ("  ",)], "query string")
    assert sorted((r.query, r.price, r.origin) for r in off.find_offers(q, shop, org).collect()) == [("a", 10.0, "shopping"), ("b", 5.0, "organic")]


def test_answer_without_url_finds_the_offer_without_url(spark):
    q = spark.createDataFrame([("s", 0, T0, "n"), ("s", 1, T0, "n")], "session_id string, line_index int, asked_at timestamp, name string")
    c = spark.createDataFrame([("s", 0, "internet", None, None, T0, 1), ("s", 1, "internet", None, "u9", T0, 2)], CHOICE)
    shown = spark.createDataFrame([("s", 0, 1, None, None, 3.0, "u1", "T1", "A"), ("s", 0, 2, None, None, 4.0, None, None, "B"), ("s", 1, 1, None, None, 5.0, "u1", "T", "A")],
                                  "session_id string, line_index int, rank int, id string, name string, price double, url string, title string, supplier string")
    got = {r.line_index: (r.source, r.product_name, r.product_supplier, r.price) for r in route_ops.apply_choices(q, c, shown).collect()}
    assert got == {0: ("user_selected_internet", "n", "B", 4.0), 1: ("user_selected_internet", None, None, None)}


def test_cancel_keeps_answers_given_before(spark):
    q = spark.createDataFrame([("s", 0, T0), ("s", 1, T0), ("s", 2, T0 + 3 * MIN)], "session_id string, line_index int, asked_at timestamp")
    c = spark.createDataFrame([("s", 0, "product", "7", None, T0 + MIN, 1), ("s", 1, "cancel", None, None, T0 + 2 * MIN, 2)], CHOICE)
    lines = spark.createDataFrame([("s", 0, T0), ("s", 3, T0 + 4 * MIN)], "session_id string, line_index int, started_at timestamp")
    got = {(r.kind, r.line_index): r.state for r in route_ops.cancel_session(q, c, lines).collect()}
    assert got == {("question", 0): "answered", ("question", 1): "cancelled", ("question", 2): "cancelled", ("line", 0): "kept", ("line", 3): "dropped"}


CATALOG = [(1, "Meja Kantor Olympic", "Olympic", "Furniture", 100.0, "pcs"), (2, "Kursi Kantor Chitose", "Chitose", "Furniture", 50.0, "pcs"),
           (3, "Kertas HVS A4 80gr Sinar Dunia", "Sinar Dunia", "ATK", 5.0, "rim"), (4, "Kertas HVS A4 80gr Paperone", "Paperone", "ATK", 6.0, "rim")]


def test_from_lines_to_quotation(spark):
    cat = spark.createDataFrame(CATALOG, "id long, name string, brand string, category string, price double, unit string").withColumn(
        "price", F.col("price").cast("decimal(15,2)"))
    raw = ["2 pcs Meja Kantor Olympic", "10 rim Kertas HVS A4 80gr", "10 RIM kertas hvs a4 80gr", "zzz qqq vvv", "zzz qqq vvv", "  ", "boom", "BOOM"]
    lines = spark.createDataFrame([("s", i, x, i) for i, x in enumerate(raw)], "session_id string, line_index int, raw_text string, qvec_id long")
    shop = spark.createDataFrame([("zzz qqq vvv", 1, 30.0, None, "Toko", "Barang", "u1", None)], SHOP)
    org = spark.createDataFrame([], ORG)

    def extract(df):
        def provider(texts):
            if any("boom" in t.lower() for t in texts):
                raise RuntimeError("no answer")
            return texts

        from penawar.operators.extract import extract_rules
        return extract_rules(prov.call_provider(df, "raw_text", provider).drop("response"))

    out = route_ops.match_lines(lines, cat, None, shop, org, extract=extract)
    by = {r.line_index: r for r in out["lines"].collect()}
    assert sorted(by) == [0, 1, 2, 3, 4, 6, 7]
    assert by[0].source == "auto_database" and by[0].product.name == "Meja Kantor Olympic" and by[0].price == 100.0
    assert (by[6].source, by[6].error, by[7].source, by[7].cached) == ("error", "no answer", "error", False)
    pend = route_ops.pending_questions(out["lines"])
    assert sorted((r.line_index, r.reason) for r in pend.collect()) == [(1, "ambiguous"), (3, "internet_fallback")]
    shown = route_ops.question_candidates(pend, out["candidates"], out["offers"])
    queue = {r.line_index: r for r in route_ops.review_queue(pend, shown).collect()}
    assert queue[1].candidates[0].id == by[1].suggested_id and {c.id for c in queue[1].candidates} == {"3", "4"}
    assert queue[1].candidates[0].score_pct == 100 and queue[3].candidates[0].url == "u1"
    c = spark.createDataFrame([("s", 1, "product", "3", None, T0, 1), ("s", 3, "internet", None, "u1", T0 + MIN, 2)], CHOICE)
    res = route_ops.close_lines(out["lines"], route_ops.apply_choices(pend.withColumn("asked_at", F.lit(T0)), c, shown))
    got = {r.line_index: (r.source, r.price, r.cached) for r in res.collect()}
    assert got == {0: ("auto_database", 100.0, False), 1: ("user_selected_db", 5.0, False), 2: ("user_selected_db", 5.0, True),
                   3: ("user_selected_internet", 30.0, False), 4: ("user_selected_internet", 30.0, True), 6: ("error", None, False), 7: ("error", None, True)} \
        or got[7] == ("error", None, False)
    edits = spark.createDataFrame([("s", 3, "2", None, None, None, None, "10"), ("s", 6, None, None, None, "Manual", "1500", None)],
                                  "session_id string, line_index int, qty_text string, unit_text string, name_text string, product_text string, "
                                  "price_text string, margin_text string")
    edited = route_ops.edit_results(res, edits)
    assert edited.columns == res.columns
    total = quote.quotation_total(edited).first()
    assert total.total == pytest.approx(2 * 100 + 10 * 5 + 10 * 5 + 2 * 30 * 1.1 + 30 + 1500) and total.lines_without_price == 1
    sheet = {r.sheet_row: r for r in quote.quotation_sheet(edited).collect()}
    assert sheet[len(got) + 2].subtotal == pytest.approx(total.total)
    assert [sheet[i + 1].product_label for i in range(len(got))][-2:] == ["Manual", "ERROR: no answer"]


def test_provider_failures_stay_with_their_rows(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(120)], "i long, t string")

    def provider(texts):
        if "t7" in texts or "t77" in texts:
            raise ValueError("bad row")
        return [x.upper() for x in texts]

    got = {r.i: (r.response, r.error, r.source) for r in prov.error_results(prov.call_provider(df, "t", provider)).collect()}
    assert {i for i, (_, e, _) in got.items() if e} == {7, 77}
    assert got[7] == (None, "bad row", "error") and got[8] == ("T8", None, None)


def test_blank_name_finds_nothing(spark):
    cat = spark.createDataFrame([(1, "Meja", "", "", 1.0, "pcs", [1.0, 0.0])], "id long, name string, brand string, category string, price double, unit string, embedding array<float>")
    pairs = spark.createDataFrame([("  ", 1), ("Meja", 1)], "name string, qvec_id long")
    qv = spark.createDataFrame([(1, [1.0, 0.0])], "qvec_id long, qvec array<float>")
    got = hybrid_search(pairs, cat, qv).collect()
    assert [(r["name"], r.id) for r in got] == [("Meja", "1")] and got[0].rrf == pytest.approx(2 / 61)


def test_reciprocal_rank_fusion(spark):
    df = spark.createDataFrame([(1, 2), (None, 1), (3, None), (None, None)], "t_rn int, v_rn int")
    assert [r[0] for r in df.select(rrf()).collect()] == pytest.approx([1 / 61 + 1 / 62, 1 / 61, 1 / 63, 0.0])


CH = ("change_id long, op string, id long, name string, brand string, category string, unit string, price string, "
      "has_name boolean, has_brand boolean, has_category boolean, has_unit boolean, has_price boolean")


def change(no, op, ident, name=None, price=None):
    return (no, op, ident, name, None, None, None, price, name is not None, False, False, False, price is not None)


def test_changes_apply_in_order(spark):
    cat = spark.createDataFrame([(1, "A", None, None, 1.0, "pcs"), (2, "B", None, None, 2.0, "pcs")],
                                "id long, name string, brand string, category string, price double, unit string").withColumn("price", F.col("price").cast("decimal(15,2)"))
    ch = [change(1, "update", 1, price="5"), change(2, "delete", 1), change(3, "update", 1, name="late"), change(4, "delete", 1), change(5, "update", 3, name="early"),
          change(6, "create", None, "C"), change(7, "update", 3, price="9"), change(8, "update", 2, price="10d"), change(9, "update", 2, price="  "),
          change(10, "create", None, "D"), change(11, "delete", 4), change(12, "update", None, name="x")]
    out = cat_ops.apply_changes(cat, spark.createDataFrame(ch, CH))
    f = lambda x: None if x is None else float(x)
    assert {r.id: (r.name, f(r.price), r.reembed) for r in out["snapshot"].collect()} == {2: ("B", 0.0, False), 3: ("C", 9.0, True)}
    assert {r.id: f(r.price) for r in out["deleted"].collect()} == {1: 5.0, 4: None}
    assert sorted(r.change_id for r in out["missing"].collect()) == [3, 4, 5, 12]
    assert [r.change_id for r in out["rejected"].collect()] == [8]
    assert {r.id: f(r.price) for r in out["created"].collect()} == {3: None, 4: None}
    assert {r.id for r in out["updated"].collect()} == {1, 2, 3}


def test_search_text_with_backslash_and_wildcards(spark):
    cat = spark.createDataFrame([(1, "ab", "", ""), (2, "a%b", "", ""), (3, "a_b", "", ""), (4, "axb", "", "")], "id long, name string, brand string, category string")
    ids = lambda q: sorted(r.id for r in cat_ops.search_filter(cat, q).collect())
    assert ids("a\\b") == [1] and ids("a\\%b") == [2] and ids("a\\_b") == [3] and ids("a_b") == [2, 3, 4] and ids(" ") == [1, 2, 3, 4]


def test_page_past_the_end_keeps_the_total(spark):
    cat = spark.createDataFrame([(i, f"n{i}", "", "") for i in range(30)], "id long, name string, brand string, category string")
    rows = cat_ops.catalog_page(cat, "n", 25, 100).collect()
    assert [(r.id, r.total) for r in rows] == [(None, 30)]
    assert [(r.id, r.total) for r in cat_ops.catalog_page(cat, "n", 25, 25).collect()] == [(i, 30) for i in range(25, 30)]


def test_starts_of_a_running_session(spark):
    rows = [("a", 1, 0, 10), ("a", 2, 5, 15), ("a", 3, 10, 20), ("a", 4, 10, 12), ("a", 5, 20, 20), ("a", 6, 20, 20), ("a", 7, 20, 90), ("a", 8, 100, 101), ("b", 1, 3, 4)]
    rows += [("h", i, i, i + 1 + i % 3) for i in range(400)]
    df = spark.createDataFrame([(s, i, T0 + a * MIN, T0 + b * MIN) for s, i, a, b in rows], "session_id string, start_id long, start_at timestamp, end_at timestamp")
    want, busy = {}, {}
    for s, i, a, b in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[s, i] = s not in busy or a >= busy[s]
        if want[s, i]:
            busy[s] = b
    got = {(r.session_id, r.start_id): r.accepted for r in sessions.duplicate_start(df, bucket=600).collect()}
    assert got == want
    ends = spark.createDataFrame([("a", T0 + 4 * MIN)], "session_id string, at timestamp")
    assert {r.start_id for r in sessions.duplicate_start(df.where("session_id = 'a'"), ends).where("accepted").collect()} == {1, 2, 5, 6, 7, 8}


def test_request_guard(spark):
    df = spark.createDataFrame([("s", True), ("", True), (None, True), ("s", False)], "session_id string, has_lines boolean")
    assert [r.error for r in sessions.validate_requests(df).collect()] == [None] + ["sessionId and lines[] are required"] * 3


def test_lines_of_files_and_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("  satu \r\n\r\ndua\n  \ntiga".encode())
    files = src_lines.read_text_files(spark, str(tmp_path))
    got = [(r.line_index, r.line) for r in src_lines.lines_from_text(files, ["path"]).orderBy("line_index").collect()]
    assert got == [(0, "satu"), (1, "dua"), (2, "tiga")]
    rows = spark.createDataFrame([(1, 10.0, "rim", 25000000.0), (2, None, " ", 2.5), (3, None, None, None)], "k long, q double, u string, p double")
    assert {r.k: r.line for r in src_lines.lines_from_table(rows, ["k"], ["q", "u", "p"]).collect()} == {1: "10 rim 25000000", 2: "2.5"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(10, "Meja", "F"), (20, "Kertas", "ATK"), (30, "Kursi", "F")], "seed_order long, name string, category string")
    path = str(tmp_path / "catalog")
    assert [(r.category, r.first_id, r.n_rows) for r in sinks.write_catalog(rows, path).collect()] == [("F", 1, 2), ("ATK", 2, 1)]
    with pytest.raises(RuntimeError):
        sinks.write_catalog(rows, path)
    sinks.write_catalog(rows.limit(1), path, reset=True)
    assert [r.id for r in spark.read.parquet(path).collect()] == [1]
    sheet = spark.createDataFrame([("s", 2, "total"), ("s", 1, "item")], "session_id string, sheet_row long, row_kind string").withColumn("export_date", F.lit("2024-01-02"))
    sinks.write_sheet(sheet, str(tmp_path / "sheet"))
    assert (tmp_path / "sheet" / "export_date=2024-01-02").is_dir()
    sinks.write_snapshot(rows.withColumn("reembed", F.lit(True)), str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).columns == ["seed_order", "name", "category"]
    with pytest.raises(ValueError):
        quote.export_dated(rows.limit(0), rows)


def test_cluster_without_checkpoint_folder_is_refused(monkeypatch):
    from penawar import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_each_provider_fails_for_some_lines(spark, tmp_path):
    """Extraction, reranker and offers fail for some lines, which become errors; a failing query vector leaves the
    trigram ranks (E4); the other lines are as without failures. Repeats of a failed line are called again (J8)."""
    from penawar.operators import embed, offers, rerank
    from penawar.operators.extract import extract_rules

    cat = spark.createDataFrame(CATALOG, "id long, name string, brand string, category string, price double, unit string").withColumn(
        "price", F.col("price").cast("decimal(15,2)"))
    cat = embed.apply_embeddings(cat.withColumn("embedding", F.lit(None).cast("array<float>")),
                                 embed.embed_texts(embed.embedding_todo(cat.withColumn("embedding", F.lit(None).cast("array<float>"))), embed.hashed_trigram_provider(32)))
    raw = ["2 pcs Meja Kantor Olympic", "10 rim Kertas HVS A4 80gr", "4 rim Kertas HVS A4", "zzz qqq vvv", "yyy www uuu", "boom", "BOOM", "flaky kursi", "FLAKY kursi", "Flaky Kursi",
           "Kursi Kantor Chitose"]
    lines = spark.createDataFrame([("s", i, x, i) for i, x in enumerate(raw)], "session_id string, line_index int, raw_text string, qvec_id long")

    def failing(word, answer):
        def provider(texts):
            if any(word in t for t in texts):
                raise RuntimeError(f"no answer to {word}")
            return [answer(t) for t in texts]

        return provider

    def extract(df):
        def provider(texts):
            if any("boom" in t.lower() or t == "flaky kursi" for t in texts):
                raise RuntimeError("no line")
            return texts

        return extract_rules(prov.call_provider(df, "raw_text", provider).drop("response"))

    texts = lines.select("qvec_id", F.col("raw_text").alias("text"))
    vector = embed.hashed_trigram_provider(32)
    verdict = lambda t: '{"id": "4", "confidence": 0.9, "reason": "ok"}'
    offer = lambda t: '[{"supplier": "Toko", "title": "Barang", "price": "Rp 9.000", "url": "u"}]'

    def run(fail):
        bad = (lambda w: w) if fail else (lambda w: "\x00")
        vectors = embed.embed_queries(texts, failing(bad("Meja"), lambda t: vector([t])[0]))
        out = route_ops.match_lines(lines, cat, vectors, None, None, extract=extract, rerank=rerank.provider_reranker(failing(bad("Kertas HVS A4\n"), verdict)),
                                    find=offers.provider_offers(failing(bad("yyy"), offer)))
        return {r.line_index: r for r in out["lines"].collect()}, out["candidates"].collect()

    good, good_c = run(False)
    got, cands = run(True)
    said = {i: (r.source, r.error) for i, r in got.items()}
    assert said[2] == ("error", "no answer to Kertas HVS A4\n") and said[4] == ("error", "no answer to yyy")
    assert said[5] == said[6] == said[7] == ("error", "no line")
    assert got[2].product_id is None and got[2].price is None and got[4].reason is None
    for i in (0, 1, 3, 8, 9, 10):
        assert got[i].asDict() | {"n_candidates": 0} == good[i].asDict() | {"n_candidates": 0}, i
    assert got[1].source == "auto_database_ai" and got[1].product_id == "4" and got[3].reason == "internet_fallback"
    # the repeat that succeeds serves the one after it
    assert (got[8].cached, got[9].cached) == (False, True) and got[8].source == got[9].source != "error"
    without = {c.id for c in cands if c.qvec_id == 0 and c.vector_sim > 0}
    assert not without and any(c.vector_sim > 0 for c in good_c if c.qvec_id == 0)


def test_answered_line_names_its_product(spark):
    cat = spark.createDataFrame(CATALOG, "id long, name string, brand string, category string, price double, unit string").withColumn(
        "price", F.col("price").cast("decimal(15,2)"))
    lines = spark.createDataFrame([("s", 0, "Kertas HVS A4 80gr", 0), ("s", 1, "kertas hvs a4 80gr", 0)], "session_id string, line_index int, raw_text string, qvec_id long")
    out = route_ops.match_lines(lines, cat, None, spark.createDataFrame([], SHOP), spark.createDataFrame([], ORG))
    pend = route_ops.pending_questions(out["lines"])
    c = spark.createDataFrame([("s", 0, "product", "3", None, T0, 1)], CHOICE)
    shown = route_ops.question_candidates(pend, out["candidates"], out["offers"])
    res = route_ops.close_lines(out["lines"], route_ops.apply_choices(pend.withColumn("asked_at", F.lit(T0)), c, shown)).collect()
    assert {(r.line_index, r.source, r.product_id, r["product"].id) for r in res} == {(0, "user_selected_db", "3", "3"), (1, "user_selected_db", "3", "3")}


def test_one_bad_text_leaves_its_neighbours_their_vectors(spark):
    from penawar.operators import embed

    def provider(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("bad text")
        return embed.hashed_trigram_provider(8)(texts)

    todo = spark.createDataFrame([(i, "bad" if i == 7 else f"text {i}") for i in range(60)], "id long, text string").coalesce(1)
    got = {r.id: (r.new_embedding is not None, r.error) for r in embed.embed_texts(todo, provider).collect()}
    assert got == {i: (i != 7, "bad text" if i == 7 else None) for i in range(60)}
