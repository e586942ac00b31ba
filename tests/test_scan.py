"""What RE2 finds against Java's patterns."""
import random

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.functions import scan
from recordlake.functions import text as t
from recordlake.operators import signals as sg
from recordlake.plans.digests import archive_digest

PATTERNS = [p for _, p in lx.TOPICS + lx.CODES + lx.FOLLOWUPS] + sg.VOTE_PARTS + [
    lx.EURO, lx.PERCENT, lx.ARTICLE, lx.ACT, lx.BUDGET_INSTRUCTION, lx.EXCEPTION, lx.RULE_WORDING, lx.SALE_MARKERS, lx.STREET, lx.HAMLET,
    lx.SPOKEN_DATE, r"\bfin$", "[^a-z]x", "a{2,3}?b", "(un) deux"]


def texts(n=400):
    """Pieces of the patterns in either case, among letters that fold or count as words in other ways."""
    rng = random.Random(4)
    words = """budget budgets décision modificative DECISION dépenses subvention PLU plus zonage bien présumé sans maître sans parcelle préemption DIA
    diable route routes chemin eau bureau réseau poste agents adjoint SDIS PETR PV procès-verbal fête fetes salle des fêtes marché vote votes voix pour
    2 voix contre contre : trois abstention abstentions : 4 s’abstient s'abstiennent ne prend pas part au vote est rejetée à l’unanimité à la majorité
    1 250,50 € 12 euros 7 eur eurs 3,5 % article L2121-29 et R12 loi 2023-12 décret n° 2022-7 M57 M 14 m49 dérogation exception à titre exceptionnel
    conformément au règlementation obligatoire autorise le Maire à reporté reportés sera étudié seront réalisés va être fait prix de vente vendeur : 12 bis
    rue de la Paix lieu-dit Fontbelle 3 mai 2024 1er août fin un deux""".split()
    odd = ["", "", "", " ", "s", "é", "_", "’", "-", ".", "́", "İ", "ı", "ſ", "K", " ", "\n", " ", " ", "Ⓐ", "x", "aab", "5"]
    turn = [str, str, str.upper, str.title, lambda w: w.replace("i", "ı"), lambda w: w.replace("i", "İ"), lambda w: w.replace("s", "ſ"), lambda w: w.replace("é", "É")]
    return ["", " ", "x"] + ["".join(rng.choice(odd) + rng.choice(turn)(w) + rng.choice([" ", " ", " ", rng.choice(odd)])
                                     for start in [rng.randrange(len(words))] for w in words[start:start + rng.randrange(1, 9)]) for _ in range(n)]


def test_nothing_java_finds_is_left_out(rows):
    data = texts()
    frame = rows([(x,) for x in data], "s string").select("s", F.array(*[F.col("s").rlike(t.uni(p) if not p.startswith("(?") else p) for p in PATTERNS]).alias("hit"))
    java = {r["s"]: r["hit"] for r in frame.collect()}
    wider = [scan.wide(p) for p in PATTERNS]
    assert all(wider) and scan.wide(r"(a)\1") is None
    left, found = 0, 0
    for i, p in enumerate(wider):
        for x, may in zip(data, pc.match_substring_regex(pa.array(data), p).to_pylist()):
            assert may or not java[x][i], (PATTERNS[i], x)
            left, found = left + (not may), found + java[x][i]
    assert found > 400 and left > 0.8 * (len(PATTERNS) * len(data) - found)      # few texts are left for Java's patterns


def test_counts_are_java_s(rows):
    data = texts() + [None]
    topics = [p for _, p in lx.TOPICS] + ["(a)|\\bb\\b", r"(x)\1", "a*"]
    frame = rows([(x,) for x in data], "s string").select("s", scan.counts(F.col("s"), topics).alias("got"), F.array(*[
        t.count_of("s", t.uni(p)) for p in topics]).alias("want"))
    asked = 0
    for r in frame.collect():
        if r["s"] is None:
            assert r["got"] is None
            continue
        assert all(g in (-1, w) for g, w in zip(r["got"], r["want"])), r
        assert r["got"][-2:] == [-1, -1]
        asked += sum(g < 0 for g in r["got"][:-3])
    assert 0 < asked < 0.2 * len(data) * len(lx.TOPICS)


def test_sentences_are_those_of_text(rows):
    data = texts(150) + [None, "", "  ", "M. J. K. Petit. Mme. M. Un. MM.. Deux", "A. B. C. D. E. Elan", "etc... Fin. É. Elan.　Y", "Un.\u0001 Deux. \u0001",
                         "x! « Oui. “Non? \"Si. vs. Art. Cf. Xx", " M. A. Bé. C", "St.  Jean.\tSte.. ... Anne", "ſt. Jean. ıt. X"]
    frame = rows([(x,) for x in data], "s string")
    for r in frame.select("s", t.sentences("s").alias("want"), scan.sentences(F.col("s")).alias("got"), t.squeeze("s").alias("flat"),
                          scan.squeeze(F.col("s")).alias("one")).collect():
        assert (r["got"], r["one"]) == (r["want"], r["flat"]), r["s"]


def test_marked_and_cut_texts(rows):
    frame = rows([(["un", "vote", None, "un", "vote et voix"],), (None,), ([],)], "a array<string>")
    got = [r[0] for r in frame.select(scan.marked(F.col("a"), "vote", "voix")).collect()]
    assert [[tuple(x) for x in g] if g is not None else None for g in got] == [[("vote", 1, 1), ("vote et voix", 4, 3)], None, []]
    some = rows([("déjà 12 rue Haute",), ("rue Haute",), ("rien",), (None,)], "s string").select(scan.from_first(F.col("s"), lx.STREET))
    assert [r[0] for r in some.collect()] == [" 12 rue Haute", "rue Haute", None, None]


def test_places_are_those_of_the_whole_text(rows):
    """A place is read with the character before it, whatever stands before that."""
    data = [("Bout. 51234 rue Haute, la ruerue Basse. Au 7 bis  chemin des Prés. Lieu-dit Bel Air. Puis on parle encore longtemps d’autre chose, route de Riols 11999.",), ("rue Haute",), ("rien",), (None,)]
    got = [r[0] for r in rows(data, "s string").select(sg.places("s")).collect()]
    assert [(p["label"], p["number"]) for p in got[0]] == [("rue Haute", None), ("chemin des Prés", "7 bis"), ("Bel Air", None)]
    assert [(p["label"]) for p in got[1]] == ["rue Haute"] and got[2] == [] and not got[3]


def test_digest_of_repeated_sentences(rows):
    pages = rows([(1, "Un. Le vote a lieu. Adopté à l’unanimité. Deux. Adopté à l’unanimité."), (2, "Rien."), (3, None)], "item_id int, text string")
    got = [(r["kind"], r["context"], r["sentence"]) for r in archive_digest(pages).collect()]
    assert got == [("unanimous", "Le vote a lieu.", "Adopté à l’unanimité."), ("unanimous", "Deux.", "Adopté à l’unanimité.")]
