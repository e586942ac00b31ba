import datetime as dt
import random

from pyspark.sql import functions as F

from recordlake.functions import sequences as sq
from recordlake.operators import analytics as an
from recordlake.operators import privacy as pv
from recordlake.operators import quality as qc
from recordlake.operators import resolve as rs
from recordlake.operators import search as se
from recordlake.operators import timeline as tl
from recordlake.operators import versions as vs
from recordlake.operators.running import running
from recordlake.sources import readers as rd
from recordlake.streaming import jobs

KEY = "k" * 40


def test_running_equals_plain_loop(rows):
    """A hot key over many chunks: carried values equal a loop over the whole group."""
    rng = random.Random(5)
    data = [(1 if rng.random() < 0.7 else 2, i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    out = running(rows(data, "k int, o int, v int"), ["k"], F.floor(F.col("o") / 7), ["o"], last=["v"],
                  following=["o"], sums={"s": F.coalesce("v", F.lit(0))}, maxima={"m": F.col("v")})
    got = {r["o"]: (r["prev_v"], r["next_o"], r["s"], r["m"]) for r in out.collect()}
    for k in (1, 2):
        mine = [(o, v) for kk, o, v in data if kk == k]
        total, top = 0, None
        for i, (o, v) in enumerate(mine):
            total += v or 0
            top = v if top is None else top if v is None else max(top, v)
            assert got[o] == (mine[i - 1][1] if i else None, mine[i + 1][0] if i + 1 < len(mine) else None, total, top)


def test_history(rows):
    days = [("2004-03-02",), ("2008-05-09",), ("2024-01-31",)]
    d = rows(days, "d string").withColumn("d", F.to_date("d")).withColumn("k", F.lit(1))
    missing = tl.missing_ranges(d, ["k"], F.year("d")).select(tl.range_label("first", "last").alias("r")).collect()
    assert [r["r"] for r in missing] == ["2005–2007", "2009–2023"]
    gap = tl.gaps(d, ["k"], "d", 180).orderBy("after").collect()
    assert str(gap[-1]["before"]) == "2024-01-31" and len(gap) == 2


def test_spellings_equal_brute_force(rows):
    from difflib import SequenceMatcher
    rng = random.Random(2)
    base = ["Delperier", "Montagnac", "Sarrazin", "Bellefontaine", "Rouquette"]
    names = [n for n in base for _ in range(5)]
    for n in base:
        i = rng.randrange(1, len(n) - 1)
        names += [n[:i] + "x" + n[i + 1:], n[:i] + n[i + 1:], n[:i] + "yz" + n[i:]]
    names += ["Delpérier", "Zorba", "Zola"]
    got = {r["name"]: r["canon"] for r in rs.canonical_names(rows([(n,) for n in names], "name string")).collect()}
    fold = lambda s: s.lower().replace("é", "e")
    counts = {n: names.count(n) for n in names}
    canon, kept = {}, []
    for n in sorted(counts, key=lambda n: (-counts[n], n)):
        close = [k for k in kept if SequenceMatcher(None, *sorted((fold(n), fold(k)))).ratio() >= 0.85]
        canon[n] = close[0] if close else n
        if not close:
            kept.append(n)
    assert got == canon and got["Delpérier"] == "Delperier" and got["Zola"] == "Zola"


def test_near_pairs_equal_brute_force(rows):
    rng = random.Random(3)
    pts = [(round(43 + rng.random() / 50, 4), round(2 + rng.random() / 50, 4)) for _ in range(150)]
    got = rs.near_pairs(rows(pts, "lat double, lon double"), 200.0).collect()
    import math
    want = 0
    for i, a in enumerate(sorted(set(pts))):
        for b in sorted(set(pts))[i + 1:]:
            want += math.hypot((a[1] - b[1]) * 111320 * math.cos(math.radians(a[0])), (a[0] - b[0]) * 110574) < 200
    assert len(got) == want > 0


def test_ledger(rows):
    z = None
    data = [("70311", 0, 1000), ("7311", 0, 5000), ("7391", 500, 0), ("74121", 0, 2000), ("775", 0, 9999),
            ("6411", 3000, 0), ("6419", 0, 200), ("66111", 100, 0), ("6811", 7777, 0), ("676", 1234, 0),
            ("1641", 0, 4000), ("165", 0, 100)]
    main = [(2020, c, float(d), float(k), z, z, "DEF", "M14", "BP", z) for c, d, k in data]
    main += [(2020, "2315", z, z, 800.0, z, z, "M14", "BP", z), (2020, "2128", z, z, 200.0, 50.0, z, "M14", "BP", z),
             (2020, "1641", z, 99999.0, z, z, z, "M14", "BA", z), (2021, "1641", z, 5.0, z, z, z, "M57", z, "3")]
    df = rows(main, "year int, compte string, sd double, sc double, obnetdeb double, obnetcre double, bal string, nomen string, budget string, cbudg string")
    for c in ("sd", "sc", "obnetdeb", "obnetcre"):
        df = df.withColumn(c, F.col(c).cast("decimal(18,2)"))
    got = [r.asDict() for r in an.ledger_rollup(df).collect()]
    assert got == [dict(year=2020, revenue=7500, spending=2900, staff=2800, interest=100, taxes=4500, state=2000,
                        investment=950, debt=4000, nomenclature="M14", result=4600)]


def test_places(rows):
    cand = rows([("rue des Tilleuls", "street"), ("chemin de la Fontaine", "street"), ("rue Perdue", "street"),
                 ("cours de natation", "street")], "label string, kind string")
    gaz = rows([(1, "Rue du Tilleul", "street", "99001", 0.9, 43.1, 2.1), (2, "Chemin de la Fontaine", "street", "99001", 0.4, 43.2, 2.2),
                (3, "Chemin de la fontaine vieille", "locality", "99001", 0.8, 43.3, 2.3), (4, "Rue Perdue", "street", "88001", 0.9, 43.4, 2.4)],
               "rank int, name string, type string, citycode string, score double, lat double, lon double")
    ok = rs.confirm_places(cand, gaz, "99001")
    assert {r["label"]: r["rank"] for r in ok.collect()} == {"rue des Tilleuls": 1, "chemin de la Fontaine": 3}
    left = rs.unconfirmed(cand, ok).collect()
    assert [r["label"] for r in left] == ["rue Perdue"]
    clean = rows([("place des Tilleuls sont",), ("rue Haute (bas)",)], "s string").select(rs.search_label("s").alias("x"))
    assert [r["x"] for r in clean.collect()] == ["place des Tilleuls", "rue Haute"]


def test_captures(rows):
    data = [("2", "http://x.fr/docs/CRCM200903.html", "text/html", "1"), ("1", "http://x.fr/CRCM%2020_09_03.rtf", "text/rtf", "1"),
            ("3", "http://x.fr/CRCM140504.pdf", "application/pdf", "1"), ("4", "http://x.fr/photo.pdf", "application/pdf", "1")]
    out = rs.choose_minutes(rows(data, "timestamp string, original string, mimetype string, length string")).orderBy("key").collect()
    assert [(r["key"], r["mimetype"], str(r["date_hint"])) for r in out] == [
        ("140504", "application/pdf", "2004-05-14"), ("200903", "text/html", "2003-09-20")]


def test_redaction_and_leaks(rows):
    pages = rows([(1, "Vu par Jean-Pierre MARTIN et Martin Jean Pierre. Élise ROUX salue."), (2, "Martin seul.")], "doc bigint, text string")
    names = rows([("Martin Jean Pierre",), ("Elise Roux",), ("Martin",)], "name string")
    out = {r["doc"]: r for r in pv.redact(pages, names, ["doc"], "doc", KEY).collect()}
    assert out[1]["redactions"] == 3 and "MARTIN" not in out[1]["text"] and out[2]["text"] == "Martin seul."
    assert len({w for w in out[1]["text"].replace(".", " ").split() if w.startswith("P-")}) == 2
    clean = rows([(r["doc"], r["text"]) for r in out.values()], "doc bigint, text string")
    assert pv.leak_check(clean, names, ["doc"]).count() == 0
    assert [r["doc"] for r in pv.leak_check(pages, names, ["doc"]).collect()] == [1]


def test_pseudonyms_equal_hmac(rows):
    import hashlib
    import hmac
    from recordlake.functions import ids
    got = rows([("Zoé  Martin",)], "n string").select(ids.master_id("n", KEY), ids.public_id("n", F.lit(7), KEY)).first()
    mac = lambda m: hmac.new(KEY.encode(), m.encode(), hashlib.sha256).hexdigest()
    assert got[0] == "M-" + mac("master|martin zoe")[:12] and got[1] == "P-" + mac("public|7|martin zoe")[:10]


def test_allow_list(rows):
    d = dt.date
    figures = rows([("Ada Lune", d(2020, 1, 1), d(2021, 1, 1)), ("Ben Sol", None, None)], "name string, valid_from date, valid_to date")
    asked = rows([(1, "LUNE Ada", d(2020, 6, 1)), (2, "Ada Lune", d(2022, 6, 1)), (3, "Ada Lune", None), (4, "Ben Sol", None), (5, "Cy Vent", None)],
                 "i int, name string, doc_date date")
    assert {r["i"]: r["allowed"] for r in pv.allowed(asked, figures).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    bad = rows([("Ada", "elected_official", "x", None), ("Ada Lune", "star", "x", None), ("Ben Sol", "business_owner", "x", None),
                ("Cy Vent", "elected_official", "ok", None)], "name string, category string, basis string, diffusion_checked boolean")
    assert pv.validate_figures(bad).count() == 3


def test_vocabulary_masking(rows):
    common = rows([("le",), ("salue",), ("conseil",)], "word string")
    roster = rows([("dupuis",)], "word string")
    s = rows([(1, "Le Conseil salue Dupuis, Zorg et DUPUIS ici."), (2, "Zorg salue.")], "id int, sentence string")
    out = {r["id"]: r["masked"] for r in pv.mask_by_vocabulary(s, common, roster, "id").collect()}
    assert out == {1: "Le Conseil salue [name withheld] ici.", 2: "Zorg salue."}


def test_publication(rows):
    docs = rows([(1, "h1", [2]), (2, "h2", []), (3, "h3", [1]), (4, "h4", [])], "doc_id int, sha256 string, review_pages array<int>")
    ok = rows([(1, "h1", [2], []), (2, "old", [], []), (3, "h3", [], [])], "doc_id int, approved_sha256 string, withheld_pages array<int>, accepted_pages array<int>")
    gate = pv.approval_gate(docs, ok)
    assert {r["doc_id"]: r["state"] for r in gate.collect()} == {1: "approved", 2: "stale", 3: "undecided", 4: "awaiting"}
    pages = rows([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "doc_id int, page int, text string")
    assert sorted((r["page"], r["text"]) for r in pv.public_pages(pages, gate).collect()) == [(1, "a"), (2, None)]


def test_versions(rows):
    old = rows([(1, "a"), (2, "b  c"), (3, "d"), (4, "e")], "page int, text string")
    new = rows([(1, "a"), (2, "b c"), (3, "x"), (5, "f")], "page int, text string")
    got = {r["page"]: r["status"] for r in vs.diff_pages(old, new, ["page"]).collect()}
    assert got == {1: "unchanged", 2: "whitespace_only", 3: "changed", 4: "removed", 5: "added"}
    diff = sq.unified_diff(rows([("a\nb", "a\nc")], "o string, n string"), "o", "n").first()["diff"]
    assert "-b" in diff and "+c" in diff


def test_quality(rows):
    pair = rows([("Coût 12 000,50 € art L2121-29", "Cost €12,000.50 L 2121-29", ["T1"])], "s string, o string, t array<string>")
    got = pair.select(qc.numbers_preserved("s", "o"), qc.refs_preserved("s", "o"), qc.placeholders_preserved("o", F.col("t")),
                      qc.figures_in_source("s", "o"), qc.no_preamble(F.lit("Voici le texte"))).first()
    assert list(got)[1:] == [True, False, True, False]
    cites = rows([("Vu [p. 3-4] et [p. 9]",)], "s string").select(qc.pages_cited("s"), qc.pages_exist("s", F.lit(8))).first()
    assert list(cites) == [True, False]


def test_search(rows):
    data = [("item", "1", "fr", "École", "La cantine de l’école ouvre"), ("item", "2", "fr", "Pont", "le pont et l’écolier"),
            ("summary", "1", "en", "", "the school canteen")]
    t = rows(data, "kind string, ref string, lang string, title string, body string")
    index, size = se.build_index(t), se.corpus_size(t)
    find = lambda q, **k: [(r["kind"], r["ref"]) for r in se.search(index, size, q, **k).collect()]
    assert find("ecol") == [("item", "1"), ("item", "2")] and find("cantine école") == [("item", "1")]
    assert find('" OR * (') == [] and find("") == [] and find("pont OR canteen") == []
    assert find("canteen", lang="fr") == [] and find("canteen", lang="en") == [("summary", "1")]
    marked = t.select(se.highlight("body", se.parse_query("ecole"), 3)).first()[0]
    assert marked == "…cantine de [l’école]…"


def test_rate_limit_batch_and_rule(rows):
    data = [(1, i, float(s)) for i, s in enumerate([0, 1, 2, 3, 30, 61, 62, 200, 201])]
    got = jobs.rate_limit_batch(rows(data, "c bigint, i bigint, s double"), "c", "s", "i", F.floor(F.col("s") / 50), 3, 60.0)
    waits = {r["i"]: r["wait"] for r in got.collect()}
    assert waits == {0: 0, 1: 0, 2: 0, 3: 58, 4: 31, 5: 0, 6: 0, 7: 0, 8: 0}


def test_stream_over_several_files_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    data = [(rng.randrange(3), i, start + dt.timedelta(hours=i), rng.choice("ab") if i % 11 else None) for i in range(120)]
    schema = "u bigint, i bigint, ts timestamp, sha string"
    src = str(tmp_path / "src")
    for part in range(4):
        spark.createDataFrame(data[part * 30:(part + 1) * 30], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.ingest_versions(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "u", ["ts", "i"], "sha",
                             F.date_trunc("day", F.col("ts"))).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "out/versions"))
    got = sorted((r["u"], r["i"], r["version"]) for r in log.collect())
    batch = tl.version_chain(spark.createDataFrame(data, schema).where("sha IS NOT NULL"), ["u"], ["ts", "i"], "sha",
                             F.date_trunc("day", F.col("ts")))
    assert got == sorted((r["u"], r["i"], r["version"]) for r in batch.collect()) and len(got) > 20


def test_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"document_id": "x", "version": 1, "pages": [{"page": 1, "text": "a"}, {"page": 2, "ocr": {"mean_conf": 58.7}}]}')
    (tmp_path / "c.json").write_text("not json")
    documents, pages, bad = rd.read_records(spark, str(tmp_path))
    assert documents.count() == 1 and pages.count() == 2 and bad.count() == 1
    html = "<head><title>x</title></head><p>Un&nbsp;mot<br>deux</p><script>no</script><table><tr><td>a</td><td>b</td></tr></table>"
    text = spark.createDataFrame([(html,)], "h string").select(rd.html_to_text("h")).first()[0]
    assert text == "Un mot\ndeux\n\na b\n"
    (tmp_path / "cap.txt").write_text('[["timestamp","original","mimetype","length"],\n["1","http://x/a.pdf","application/pdf","5"],\n["2","u","m","6"]]')
    assert [r["timestamp"] for r in rd.read_captures(spark, str(tmp_path / "cap.txt")).orderBy("timestamp").collect()] == ["1", "2"]


def test_sql_functions(spark):
    from recordlake.functions.sqlapi import register_functions
    assert "rl_fold" in register_functions(spark)
    assert spark.sql("SELECT rl_fold('ÉCOLE'), rl_plain('L’École!')").first()[0] == "ecole"
    assert spark.sql("SELECT * FROM rl_amounts('1 500 € et 3 %')").count() == 2


def test_whats_new(rows):
    from recordlake.plans.digests import archive_digest, whats_new
    d = dt.date
    data = [(d(2026, 6, 5), "Pont", False, ["La réunion du pont aura lieu le 27 septembre 2026."], [("deferred", "Le pont est reporté.")]),
            (d(2026, 5, 5), "Pont", False, ["La réunion du pont aura lieu le 27 septembre 2026."], []),
            (d(2026, 4, 5), "Vente", True, ["Le prix est fixé le 1er octobre 2026."], [("deferred", "Vente reportée.")]),
            (d(2020, 1, 5), "Vieux", False, ["La fête aura lieu le 2 mars 2020."], [])]
    items = rows(data, "date date, title string, sensitive boolean, sentences array<string>, followups array<struct<type:string,sentence:string>>")
    threads = rows([("Pont", d(2026, 6, 5), True), ("Vieux", d(2020, 1, 5), False)], "title string, last date, possibly_dropped boolean")
    got = sorted((r["section"], str(r["date"]), r["title"], r["detail"]) for r in whats_new(items, threads, 2, 3).collect())
    assert got == [("date", "2026-05-05", "Pont", "2026-09-27"), ("decision", "2026-05-05", "Pont", ""), ("decision", "2026-06-05", "Pont", ""),
                   ("dropped", "2026-06-05", "Pont", ""), ("pending", "2026-06-05", "Pont", "Le pont est reporté.")]
    seen = rows([("Pont", d(2026, 6, 5), False, "recurring", 3), ("Halle", d(2026, 6, 5), False, "one-off", 1), ("Vieux", d(2020, 1, 5), False, "returned", 2)],
                "title string, last date, possibly_dropped boolean, status string, n_meetings int")
    topical = items.withColumn("topics", F.when(F.col("title") == "Pont", F.array(F.lit("voirie et travaux"))).otherwise(F.array(F.lit("finances"))))
    more = {(r["section"], str(r["date"]), r["title"], r["detail"]) for r in whats_new(topical, seen, 2, 3).collect()} - set(got)
    # the sensitive item is not counted, and the old one is seen but not of the last year
    assert more == {("back", "2026-06-05", "Pont", "3"), ("watch", "2026-06-05", "voirie et travaux", "2/2"), ("watch", "2020-01-05", "finances", "0/0")}
    pages = rows([(1, "Le pont est vieux. Vote du conseil à l’unanimité. Le prix de vente est dit. Adopté à la majorité.")], "doc int, text string")
    out = [(r["sale"], r["kind"], r["context"]) for r in archive_digest(pages).collect()]
    assert out == [(False, "unanimous", "Le pont est vieux."), (True, "majority", None)]


def test_mask_and_restore(rows):
    r = rows([("Ada voit Ben et Ada.",)], "s string").select(pv.mask_tokens("s", "[A-Z][a-z]+").alias("m")).select(
        "m.*", pv.unmask(F.col("m.text"), F.col("m.mapping")).alias("back")).first()
    assert r["text"] == "⟦N1⟧ voit ⟦N2⟧ et ⟦N1⟧." and r["back"] == "Ada voit Ben et Ada."


def test_csv_cells_and_snapshot(spark, rows, tmp_path):
    from recordlake.sources import sinks as sk
    cells = rows([("=1",), ("+1",), ("-2",), ("@x",), ("fine",), (None,)], "c string")
    assert [r["c"] for r in sk.safe_cells(cells, ["c"]).collect()] == ["'=1", "'+1", "'-2", "'@x", "fine", ""]
    df = rows([(1, "a"), (2, "b")], "k int, v string")
    sk.publish_snapshot(df, str(tmp_path), "k")
    sk.publish_snapshot(df.where("k = 1"), str(tmp_path), "k")
    assert [r["v"] for r in sk.read_snapshot(spark, str(tmp_path)).collect()] == ["a"]
    assert not sk.publish_snapshot(df.where("k = 1"), str(tmp_path), "k")       # unchanged: nothing is written
    assert sk.publish_snapshot(df, str(tmp_path), "k") and sk.publish_snapshot(df.where("k = 2"), str(tmp_path), "k")
    assert sorted(x.name for x in (tmp_path / "_lists").glob("0*")) == ["00000003", "00000004"]


def test_snapshot_rewrites_changed_partitions_only(spark, rows, tmp_path):
    from recordlake.sources import sinks as sk
    path = str(tmp_path)
    df = rows([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "v int, k string").selectExpr("k AS v", "v AS k")
    get = lambda: sorted((r["k"] or 0, r["v"] or "") for r in sk.read_snapshot(spark, path).collect())
    assert sk.publish_snapshot(df, path, "k") and get() == [(0, "d"), (1, "a"), (1, "b"), (2, "c"), (3, "")]
    first = {x.name for x in tmp_path.glob("data-*")}
    assert sk.publish_snapshot(df.withColumn("v", F.when(F.col("k") == 2, "new").otherwise(F.col("v"))), path, "k")
    fresh = [x for x in tmp_path.glob("data-*") if x.name not in first]
    assert len(fresh) == 1 and [x.name for x in fresh[0].glob("k=*")] == ["k=2"]
    assert get() == [(0, "d"), (1, "a"), (1, "b"), (2, "new"), (3, "")] and sk.read_snapshot(spark, path).columns == ["v", "k"]
    assert sk.publish_snapshot(df.where("k IS NULL"), path, "k") and get() == [(0, "d")]
    assert sk.publish_snapshot(df.limit(0), path, "k") and get() == [] and not sk.publish_snapshot(df.limit(0), path, "k")


def test_sales_by_column_name(spark, tmp_path):
    from recordlake.sources import readers as rd
    (tmp_path / "s.csv").write_text(
        "id_mutation,date_mutation,numero_disposition,nature_mutation,valeur_fonciere,code_commune,nombre_pieces_principales\n"
        "2020-1,2020-01-05,000001,Vente,150000.5,99001,4\n2020-2,x,000001,Echange,abc,,\n2020-3,2020-01-06,1,Vente,1,88002,1\n")
    got = {r.id_mutation: r for r in rd.read_sales(spark, str(tmp_path / "s.csv"), "99001").collect()}
    assert set(got) == {"2020-1", "2020-2"}
    assert got["2020-1"].nature_mutation == "Vente" and got["2020-1"].valeur_fonciere == 150000.5
    assert got["2020-2"].valeur_fonciere is None and got["2020-2"].date_mutation is None and got["2020-1"].id_parcelle is None


def test_entities_and_links(spark):
    from recordlake.sources import readers as rd
    rows = spark.createDataFrame([(1, "https://ex.org/d/e/x.html",
        "<p>F&ecirc;te d&#8217;&#xE9;t&eacute; &amp;lt; &nope; A&B &#x1F600; &#99999999;</p>"
        "<a href=\"../a.pdf?x=1&amp;y=2\">Caf&eacute; &amp; co</a><a class=k href=sub/c.pdf>C</a>"
        "<a href='./b.pdf'>B</a><a href='/../../z.pdf'>Z</a><a href='https://o.org/q/../r.pdf'>R</a>")], "page int, url string, html string")
    assert rows.select(rd.html_to_text("html").alias("v")).first().v.startswith("Fête d’été &lt; &nope; A&B 😀 &#99999999;")
    got = [(r.url, r.link_text) for r in rd.extract_links(rows, ".pdf").orderBy("link_no").collect()]
    assert got == [("https://ex.org/d/a.pdf?x=1&y=2", "Café & co"), ("https://ex.org/d/e/sub/c.pdf", "C"),
                   ("https://ex.org/d/e/b.pdf", "B"), ("https://ex.org/z.pdf", "Z"), ("https://o.org/r.pdf", "R")]


def test_names_after_titles_and_with_apostrophes(spark):
    from recordlake.operators import privacy as pv
    common = spark.createDataFrame([("martin",), ("le",), ("conseil",), ("remercie",), ("pour",), ("son",), ("aide",)], "word string")
    roster = spark.createDataFrame([("zoe",)], "word string")
    rows = spark.createDataFrame([(1, "Le conseil remercie M. Martin pour son aide."), (2, "Mme Jeanne Martin, le conseil."), (3, "Zoe aide."),
                                  (4, "Mentle aide Mentle.")], "id int, sentence string")
    got = {r.id: r.masked for r in pv.mask_by_vocabulary(rows, common, roster, "id").collect()}
    assert "Martin" not in got[1] and "M." in got[1] and "Martin" not in got[2] and "Jeanne" not in got[2] and "Zoe" not in got[3]
    assert got[4].count("Mentle") == 1
    pages = spark.createDataFrame([(1, "Présents : Jeanne d'Arc et Jeanne d’Arc.")], "page int, text string")
    names = spark.createDataFrame([("Jeanne d'Arc",)], "name string")
    assert "Arc" not in str(pv.redact(pages, names, ["page"], "page", "k" * 32).first())
    assert pv.leak_check(pages, names, ["page"]).count() > 0


def test_themes_with_undated_items(spark):
    from recordlake.operators import analytics as an
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("2020-01-01", "a"), ("2020-02-01", "a"), (None, "a"), (None, "b")], "d string, t string").withColumn("d", F.to_date("d"))
    got = sorted((r.topic, r.quarter, r.n) for r in an.themes_by_quarter(rows, F.array("t"), "d").collect())
    assert got == [("ALL", "2020-Q1", 2), ("ALL", "ALL", 4), ("ALL", "undated", 2), ("a", "2020-Q1", 2), ("a", "ALL", 3), ("a", "undated", 1), ("b", "ALL", 1), ("b", "undated", 1)]
    top = an.themes_pivot(rows, F.array("t"), "d", ["2020-Q1"]).first()
    assert (top.topic, top["2020-Q1"], top.undated, top.total) == ("ALL", 2, 2, 4)


def test_sets_and_sql_functions(spark):
    from recordlake.functions import sqlapi
    from recordlake.functions import text as t
    from recordlake.operators import sets
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, w double")
    assert sorted(str(r.k) for r in sets.except_known(a, b, "k").collect()) == ["1", "None"]
    assert [r.k for r in sets.except_known(a, a, "k").collect()] == []
    both = sets.union_sources({"a": a, "b": b})
    assert both.count() == 6 and {(r.source, r.w) for r in both.collect()} == {("a", None), ("b", 5.0), ("b", 6.0)}
    assert [r.k for r in sets.latest(a.where("k IS NOT NULL"), "k", 2, "v").collect()] == [2, 1]
    sqlapi.register_functions(spark)
    row = spark.createDataFrame([("a١2",)], "s string").selectExpr("rl_digit_share(s) AS q", "s").select("q", t.digit_share("s").alias("p")).first()
    assert row.q == row.p


def test_trial_report(rows):
    data = [("m", "fr", ok, lang, s, 10) for ok, lang, s in [(True, True, 3.5), (True, False, 1.0), (None, True, 2.2), (True, True, 2.1)]] + [
        (None, "fr", False, False, 9.0, 1), ("x", "en", True, True, None, 5)]
    df = rows(data, "model string, lang string, a boolean, b boolean, s double, t bigint")
    got = {r["model"]: tuple(r)[2:] for r in an.trial_report(df, ["model", "lang"], ["a", "b"], "s", "t").collect()}
    assert got["m"] == (4, 3, 3, 2, 2.2, 40) and got[None] == (1, 0, 0, 0, 9.0, 1)
    assert got["x"][:4] == (1, 1, 1, 1)
