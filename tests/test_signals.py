from datetime import date

import pytest
from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.functions import numbers as nb
from recordlake.functions import text as t
from recordlake.operators import signals as sg


def value(spark, expr, **cols):
    data = spark.createDataFrame([tuple(cols.values())], ", ".join(
        f"{k} {'date' if isinstance(v, date) else 'string'}" for k, v in cols.items()))
    return data.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("text, n", [
    ("Le conseil vote. Mme X s’abstient. M. le Maire propose 12,5 % de hausse.", 3),
    ("M. Martin ne prend pas part au vote. Mme Durand et J. Petit approuvent. Fin.", 3),
    ("", 0), ("Voir art. Deux. M. J. Petit et M. R. Roux.", 2)])
def test_sentences(spark, text, n):
    assert len(value(spark, t.sentences("s"), s=text)) == n


def test_sentences_as_by_the_plain_patterns(spark):
    texts = ["", "  ", "A. B", "Voir M. Petit. M.  Roux\u00a0!\tOui... Non", "etc... Fin. MM.. Durand. Cf. Xx", "Un\u2003deux. «\u202fTrois. É. Elan.\n\nVS. Fin",
             "x.\u3000Y. ÉTÉ. Z", "Art. 5. St. Jean. est. Jean", " M. A. Bé. C", "Ste.. ... Anne. (M. Un) M. Deux"]
    frame = spark.createDataFrame([(x,) for x in texts], "s string")
    flat = F.trim(F.regexp_replace("s", r"(?U)\s+", " "))
    marked = F.regexp_replace(flat, r"(?<=[.!?])\s+(?=[A-ZÀ-Ý«“\"])", t.SPLIT)
    names = "|".join(lx.ABBREVIATIONS)
    healed = F.regexp_replace(marked, rf"(?<![^ {t.SPLIT}])((?iu:{names})|\p{{Lu}})(\.+){t.SPLIT}", "$1$2 ")
    plain = F.filter(F.transform(F.split(healed, t.SPLIT), lambda x: F.trim(x)), lambda x: x != "")
    for row in frame.select("s", t.sentences("s").alias("got"), plain.alias("want"), t.squeeze("s").alias("one"), flat.alias("flat")).collect():
        assert (row.got, row.one) == (row.want, row.flat), row.s


def test_ahead_loses_no_match(spark):
    patterns = [p for _, p in lx.TOPICS + lx.CODES + lx.FOLLOWUPS] + [
        v for k, v in vars(lx).items() if isinstance(v, str) and not k.startswith("__") and k not in ("PLACEHOLDER", "PLACEHOLDERS")]
    texts = ["Le DIA et l’ÉCOLE, réſeau ﬁscal, bu\u212Aet, TAXE d'imposition ; Éƭait présent", "10 000,50 € 5 % ١٢ € 1er août 2024, 12 RUE de l’Église, lieu-dit Été",
             "à l’UNANIMITÉ, Ŀ s’abstient ; İndemnité ſubvention ISſUE artıcle L. 2121-3, M 57, AB0423 | AB | 12 |", "x" * 20, "",
             "En Vertu d’une réglementation, ſera réaliſé. budget voté, droit de préemption, dérogation, Vendeur : X\n- item 1"]
    assert t.ahead("a?") == "a?" and t.ahead(r"\w+") == r"\w+" and t.ahead("bc") != "bc"
    frame = spark.createDataFrame([(x,) for x in texts], "s string").coalesce(1)
    for flags in ("(?iuU)", "(?iu)", ""):
        row = frame.agg(*[F.min(F.regexp_extract_all("s", F.lit(flags + t.ahead(p)), F.lit(0)) == F.regexp_extract_all(
            "s", F.lit(flags + p), F.lit(0))).alias(f"p{i}") for i, p in enumerate(patterns)]).first()
        assert all(row), [p for p, ok in zip(patterns, row) if not ok]


def test_listed_words_as_by_the_plain_pattern(spark):
    texts = [None, "", "le", "le la", "Le la\nles", "1 le 2 d’un été", "l'été des les lesdits le-la", "the THE theory of-and où", "a.b c", "x" * 50 + " et est", "qui\u00a0que 𝒳le ële"]
    frame = spark.createDataFrame([(x,) for x in texts], "s string")
    low = F.lower("s")
    for words in (*lx.STOP_WORDS.values(), lx.FRENCH_FUNCTION_WORDS, lx.OTHER_FUNCTION_WORDS, ["le", "l.s"], []):
        for letter in ("[a-zà-ÿ’']", r"\p{L}"):
            plain = rf"(?<!{letter})(?:{'|'.join(words)})(?!{letter})"
            for row in frame.select("s", t.count_of(low, sg._one_of(words, letter)).alias("got"), t.count_of(low, plain).alias("want")).collect():
                assert row.got == row.want, (row.s, words)
    n, fr, other = [t.count_of(low, p) for p in (r"[\p{L}]+", *[rf"(?<!\p{{L}})(?:{'|'.join(ws)})(?!\p{{L}})" for ws in (
        lx.FRENCH_FUNCTION_WORDS, lx.OTHER_FUNCTION_WORDS)])]
    plain = (n >= 3) & (((fr >= 2) & (fr > 2 * other)) | ((fr >= 1) & (other == 0)))
    for row in frame.select("s", sg.is_french("s").alias("got"), plain.alias("want")).collect():
        assert row.got == row.want, row.s


def test_signals_are_worked_out_once(spark):
    items = spark.createDataFrame([(1, "Le budget. La voirie.")], "item_no int, text string")
    plan = sg.long(sg.with_sentences(items), "item_no", sg.rule_mentions(F.col("sentences")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("en application d") == 1


@pytest.mark.parametrize("text, kind, counts", [
    ("Vote du conseil à l’unanimité.", "unanimous", (None, None, None)),
    ("Adopté par 10 voix pour et une abstention.", "majority", (10, None, 1)),
    ("Vote : 9 voix pour, 2 contre, deux abstentions.", "majority", (9, 2, 2)),
    ("La proposition est rejetée à la majorité.", "rejected", (None, None, None))])
def test_votes(spark, text, kind, counts):
    v = value(spark, sg.votes(t.sentences("s")), s=text)
    assert [x["kind"] for x in v] == [kind]
    assert (v[0]["for"], v[0]["against"], v[0]["abstentions"]) == counts
    assert value(spark, sg.vote_result(sg.votes(t.sentences("s"))), s=text) == kind


def test_no_vote(spark):
    assert value(spark, sg.vote_result(sg.votes(t.sentences("s"))), s="Rien à signaler.") is None


@pytest.mark.parametrize("raw, number", [("12 000", 12000), ("12 000,50", 12000.5), ("3 522.01", 3522.01),
                                         ("1.049.853,58", 1049853.58), ("1861", 1861), ("0,5", 0.5)])
def test_parse_number(spark, raw, number):
    assert value(spark, nb.parse_number("s"), s=raw) == number


def test_amounts(spark):
    found = value(spark, sg.amounts(t.sentences("s")),
                  s="Coût de 1 500 € soit 39,48 % du total. Le reste : 12 345,60 euros.")
    assert [(x["kind"], x["value"]) for x in found] == [("eur", 1500.0), ("pct", 39.48), ("eur", 12345.6)]


def test_legal_refs(spark):
    text = ("Vu l’article L2121-21 du code général des collectivités territoriales. Vu le décret n° 2022-581. "
            "Vu la loi 2023-1196. Selon la M57 en vigueur. Vu l’article L1111-2 applicable.")
    keys = [r["key"] for r in value(spark, sg.legal_refs(t.sentences("s")), s=text)]
    assert keys == ["CGCT L2121-21", "décret 2022-581", "loi 2023-1196", "instruction M57", "? L1111-2"]


def test_exceptions_and_rules(spark):
    s = t.sentences("s")
    assert len(value(spark, sg.exceptions(s), s="À titre exceptionnel on ouvre. Une dérogation est donnée.")) == 2
    assert value(spark, sg.exceptions(s), s="Charges exceptionnelles inscrites.") == []
    text = "C’est obligatoire ici. Rien. Le préfet décide. Plafond 12 34 56 78 90."
    assert len(value(spark, sg.rule_mentions(s), s=text)) == 2


def test_followups(spark):
    text = "Le conseil autorise le Maire à signer. Ce point est reporté. Les travaux seront réalisés. Le résultat reporté suit."
    assert [x["type"] for x in value(spark, sg.followups(t.sentences("s")), s=text)] == [
        "authorisation", "deferred", "planned"]


def test_topics_and_markers(spark):
    hits = value(spark, sg.topic_hits("a", "b"), a="Budget primitif", b="voirie, voirie et budget")
    assert [(x["topic"], x["hits"]) for x in hits] == [("finances", 4), ("voirie et travaux", 2)]
    assert value(spark, sg.is_sensitive("a", "b"), a="Divers", b="prix de vente fixé")
    assert not value(spark, sg.is_sensitive("a", "b"), a="Divers", b="rien")


def test_places(spark):
    text = "Travaux au 19 rue des Tilleuls pour réparer. Le lieu-dit Fontbelle est aussi concerné par ce chantier. Puis route de Riols 11999 ailleurs."
    found = [(p["kind"], p["label"], p["number"]) for p in value(spark, sg.places("s", "11222"), s=text)]
    assert found == [("street", "rue des Tilleuls", "19"), ("lieu-dit", "Fontbelle", None)]


def test_parcels(spark):
    def keys(text, ocr=False):
        return [(p["section"], p["number"], p["form"]) for p in value(spark, sg.parcels("s", F.lit(ocr)), s=text)]
    assert keys("Le terrain cadastré C 551 est libre.") == [("C", "0551", "inline")]
    stacked = "Superficie totale\nAB\n99\nbourg\nC\n154\nUsage"
    assert keys(stacked) == [("AB", "0099", "table"), ("C", "0154", "table")]
    assert keys("Plan du cadastre : AB0423 ici") == [("AB", "0423", "bare")]
    assert keys("cadastrée ÆB 490.") == [] and keys("cadastrée ÆB 490.", True) == [("AB", "0490", "inline")]
    assert keys("AB0423 sans le mot") == []


def test_dates(spark):
    def found(text):
        return [str(x["mentioned"]) for x in value(spark, sg.mentioned_dates(t.sentences("s"), F.col("d")),
                                                   s=text, d=date(2026, 6, 5))]
    assert found("Le 27 septembre 2026 à midi.") == ["2026-09-27"]
    assert found("Le 1er juillet prochain.") == ["2026-07-01"]
    assert found("Le 9 avril, le 31 février 2027 et le 3 mai 2019.") == []
    doc = sg.document_date("s")
    assert value(spark, doc, s="Séance du 12 mai 2014")["value"] == "2014-05-12"
    formula = "L’an deux mil quatre et le deux Mars, séance. Le 12 mai 2014."
    assert value(spark, doc, s=formula)["value"] == "2004-03-02"
    assert value(spark, doc, s="CONSEIL MUNICIPAL DU 03/04/2015")["value"] == "2015-04-03"
    assert value(spark, doc, s="rien") is None


@pytest.mark.parametrize("name, hint", [("CRCM02032004.pdf", "2004-03-02"), ("CRCM140504.pdf", "2004-05-14"),
                                        ("CRCM%2020060505.pdf", "2006-05-05"), ("CR99999999.pdf", "None")])
def test_date_hint(spark, name, hint):
    assert str(value(spark, sg.date_hint("s"), s=name)) == hint


def test_people(spark):
    text = ("Etaient présents : Ada LUNE, Ben SOL. Etaient absents : Cora MER procuration à Ben SOL. "
            "La séance est ouverte sous la présidence de Monsieur Max VENT, Maire.")
    assert [(x["role"], x["name"]) for x in value(spark, sg.attendance("s"), s=text)] == [
        ("present", "Ada LUNE"), ("present", "Ben SOL"), ("absent", "Cora MER"), ("holder", "Ben SOL")]
    assert value(spark, sg.chair("s"), s=text) == "Vent"
    fields = value(spark, sg.private_names("s"), s="Vendeur : Ada LUNE, SCI Les Pins et\nBen SOL\nAutre : X Y")
    assert [x["name"] for x in fields] == ["Ada LUNE", "Ben SOL"]
    assert value(spark, sg.honorific_names("s"), s="Selon M. Ada LUNE et le Maire.") == ["Ada LUNE"]


def test_prose_and_clip(spark):
    assert not value(spark, t.looks_like_prose("s"), s="Grade Filière Catégorie Effectif Budget")
    assert value(spark, t.looks_like_prose("s"), s="Le conseil étudie la question du pont.")
    assert value(spark, t.clip("s", 20), s="Un mot. Deux mots de plus ici") == "Un mot. Deux mots…"
    assert value(spark, t.clip("s", 10), s="court") == "court"
    assert value(spark, t.sentence_case("s"), s="BUDGET: LA SUITE") == "Budget: La suite"
    assert value(spark, t.title_key("s"), s="Approbation du procès-verbal") == "approbation proces verbal"
    assert value(spark, nb.number_cores("s"), s="12 000,50 € et 3 %") == value(
        spark, nb.number_cores("s"), s="€12,000.50 and 3%")


def test_nothing_is_cut_by_default(spark):
    from recordlake.functions import lexicons as lx
    from recordlake.operators import analytics as an
    s = t.sentences("s")
    many = " ".join(f"Mesure {'abcdefghijklmnopqrstuvwxyz'[i]} prise à titre exceptionnel par le maire." for i in range(20))
    assert len(value(spark, sg.exceptions(s), s=many)) == 20
    assert len(value(spark, sg.exceptions(s, 3), s=many)) == 3
    rules = " ".join(f"Ces travaux {'abcdefghijklmnopqrstuvwxyz'[i]} sont menés conformément aux usages locaux." for i in range(20))
    assert len(value(spark, sg.rule_mentions(s), s=rules)) == 20
    from pyspark.sql import functions as F
    keys = F.array(*[F.struct(F.lit(f"décret 2022-{1000 + i}").alias("key")) for i in range(30)])
    got = spark.range(1).select(keys.alias("refs"), F.array().alias("wording")).select(an.basis().alias("b")).first().b
    assert got.count("décret") == 30
    from recordlake.operators import search as se
    assert len(se.parse_query(" ".join(f"mot{i}" for i in range(50)))) == 50 and se.clamp_limit(500) == 500


def test_spans_of_long_texts(spark):
    import time
    text = "x12 é3;" * 50_000
    start = time.time()
    got = value(spark, t.spans("s", "[0-9]+"), s=text)
    assert len(got) == 100_000 and time.time() - start < 60
    assert all(text[r["start"]:r["end"]] == r["text"] for r in got[::997])
    many = value(spark, t.keep_first(F.split("s", " "), lambda x: F.lower(x)), s="b a B c A b d")
    assert many == ["b", "a", "c", "d"]
    assert value(spark, t.keep_first(F.filter(F.split("s", " "), lambda x: x == "z"), lambda x: x), s="b a") == []


def test_money_list_and_clip_around(spark):
    from pyspark.sql import functions as F
    amounts = F.array(*[F.lit(float(x)) for x in (1000, 20, 3)])
    row = spark.range(1).select(nb.money_list(amounts, 2, "en").alias("a"), nb.money_list(amounts, None, "en").alias("b")).first()
    assert row.a == "€1,000, €20 +1" and row.b == "€1,000, €20, €3"
    text = " ".join(f"mot{i}" for i in range(100))
    got = value(spark, t.clip_around("s", 40, F.lit(300)), s=text)
    assert got.startswith("…mot") and got.endswith("…") and len(got) <= 42 and got.strip("…") in text
    assert value(spark, t.clip_around("s", 40, F.lit(0)), s="court") == "court"
    assert value(spark, t.clip_around("s", 40, F.lit(0)), s=text).startswith("mot0 ")
