from pyspark.sql import functions as F

from recordlake.functions import text as t
from recordlake.operators import lines as ln
from recordlake.operators import signals as sg

PAGE1 = """1
CONSEIL MUNICIPAL DU BOURG
Etaient présents : Ada LUNE, Ben SOL
- Décision modificative budgétaire
- Droits de préemption

DECISION MODIFICATIVE BUDGETAIRE
Le conseil doit voter une dépense de 12 500,00 € pour la toiture de l’école
du bourg selon l’article L2121-29 du code général des collectivités territoriales.
La suite est reportée à plus tard. Vote : une abstention au lieu-dit Fontbelle."""
PAGE2 = """DROITS DE PREEMPTION
Le bien vendu au prix de vente de 90 000,00 € ne sera pas préempté par la commune."""


def test_line_rules(rows):
    def flags(line):
        return rows([(line,)], "s string").select(t.is_heading("s"), t.is_table_line("s")).first()
    assert flags("DECISION MODIFICATIVE BUDGETAIRE")[0] and not flags("Décision modificative")[0]
    assert not flags("12")[0] and not flags("A B")[0]
    assert flags("1 049 853,58 1 126 826,58")[1] and not flags("La séance est ouverte à 19h04")[1]


def test_page_number_and_wrapping(rows):
    docs = rows([(1, "1\nPremière ligne qui continue\nsur la ligne suivante.")], "doc_id int, text string")
    blocks = ln.with_blocks(docs, ln.single_page()).first()["blocks"]
    assert [(b["kind"], b["text"]) for b in blocks] == [
        ("paragraph", "Première ligne qui continue sur la ligne suivante.")]
    docs = rows([(1, "RAPPORT DES COMMISSIONS ET\nDELEGUES\nCorps du texte.")], "doc_id int, text string")
    blocks = ln.with_blocks(docs, ln.single_page()).first()["blocks"]
    assert [b["text"] for b in blocks] == ["RAPPORT DES COMMISSIONS ET DELEGUES", "Corps du texte."]


def test_two_page_minutes(rows):
    docs = rows([(1, [(1, PAGE1), (2, PAGE2)])], "doc_id int, pages array<struct<page:int,text:string>>")
    items = ln.items(ln.with_blocks(docs, F.col("pages")).drop("pages")).orderBy("item_no")
    out = items.select("title_raw", "first_page", sg.is_sensitive("title_raw", "body").alias("sensitive"),
                       sg.vote_result(sg.votes(t.sentences("body"))).alias("vote"),
                       F.transform(sg.amounts(t.sentences("body")), lambda a: a["value"]).alias("eur"),
                       F.transform(sg.legal_refs(t.sentences("body")), lambda a: a["key"]).alias("refs"),
                       F.transform(sg.followups(t.sentences("body")), lambda a: a["type"]).alias("follow"),
                       F.transform(sg.places("body"), lambda a: a["label"]).alias("places")).collect()
    assert [r["title_raw"] for r in out] == ["DECISION MODIFICATIVE BUDGETAIRE", "DROITS DE PREEMPTION"]
    first, second = out
    assert (first["vote"], first["eur"], first["refs"], first["follow"]) == (
        "majority", [12500.0], ["CGCT L2121-29"], ["deferred"])
    assert first["places"] == ["Fontbelle"] and not first["sensitive"]
    assert second["sensitive"] and second["first_page"] == 2
    shown = t.display_title(F.lit("DECISION MODIFICATIVE BUDGETAIRE"),
                            F.array(F.lit("Décision modificative budgétaire")))
    assert items.select(shown).first()[0] == "Décision modificative budgétaire"


def test_reattach_captions(rows):
    b = "array<struct<kind:string,text:string,page:int>>"
    data = [(1, 1, "TRAVAUX DE TOITURE", 1, [("paragraph", "La toiture de la halle est refaite.", 1)], ["travaux toiture"]),
            (1, 2, "BUDGET DE L ECOLE", 1, [("paragraph", "Le budget de l'école se poursuit sans", 1)], ["travaux toiture"]),
            (1, 3, "TOITURE HALLE", 1, [("table", "1 000,00 2 000,00", 1),
             ("paragraph", "point final car la phrase reprend ici après le tableau.", 2)], ["travaux toiture"])]
    items = rows(data, f"doc_id int, item_no int, title_raw string, first_page int, blocks {b}, agenda_keys array<string>")
    out = {r["item_no"]: [x["text"] for x in r["blocks"]] for r in ln.reattach_captions(items).collect()}
    assert out == {1: ["La toiture de la halle est refaite.", "TOITURE HALLE", "1 000,00 2 000,00"],
                   2: ["Le budget de l'école se poursuit sans",
                       "point final car la phrase reprend ici après le tableau."]}


def test_captions_work_items_out_once(rows):
    b = "array<struct<kind:string,text:string,page:int>>"
    items = rows([(1, 1, "TOITURE", 1, [("paragraph", "La halle.", 1)], ["toiture"])],
                 f"doc_id int, item_no int, title_raw string, first_page int, blocks {b}, agenda_keys array<string>")
    out = ln.reattach_captions(items)
    assert [x["text"] for x in out.first()["blocks"]] == ["La halle."]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
