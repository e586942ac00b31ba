"""Default lexicons: fixed values that decide what counts as a vote, an amount, a topic, a name.

Everything here is plain data.  Jobs take these as parameters (lists or DataFrames), so a
deployment with other words passes its own; the defaults are French municipal wording.
"""

# --- Fixed values: number words -------------------------------------------------------------
NUMBER_WORDS = {"un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6,
                "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11, "douze": 12}
DATE_NUMBER_WORDS = {"un": 1, "premier": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5,
                     "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11,
                     "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16,
                     "vingt": 20, "trente": 30}

# --- Fixed values: sentence splitting ---------------------------------------------------------
ABBREVIATIONS = ["m", "mm", "mme", "mmes", "mlle", "dr", "pr", "st", "ste", "art", "n", "cf",
                 "etc", "vs"]

# --- Fixed values: votes -------------------------------------------------------------------------
COUNT_WORD = r"(\d{1,2}|un|une|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze)"
VOTE_GUARD = r"\bvote|unanimit|majorité|voix|abstien|abstention|s’oppose|se prononce"
VOTE_REJECTED = r"(?:est|sont) rejet[ée]e?s?|le conseil (?:refuse|rejette)"
VOTE_UNANIMOUS = r"à l[’']unanimité"
VOTE_MAJORITY = r"à la majorité"
VOTE_FOR = COUNT_WORD + r"\s+voix\s+pour"
VOTE_AGAINST = COUNT_WORD + r"\s+(?:voix\s+)?contre|contre\s*:\s*" + COUNT_WORD
VOTE_ABSTENTION = COUNT_WORD + r"\s+abstentions?|abstentions?\s*:\s*" + COUNT_WORD
VOTE_ABSTAINS = r"s[’']abstien(?:t|nent)"
VOTE_NO_PART = r"ne prend(?:nent)? pas part au vote"

# --- Fixed values: amounts -------------------------------------------------------------------------
EURO = (r"(\d{1,3}(?:[   .]\d{3})+(?:,\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
        r"\s*(?:€|euros?\b|EUR\b)")
PERCENT = r"(\d+(?:,\d+)?)\s*%"

# --- Fixed values: legal references -----------------------------------------------------------------
CODES = [
    ("CGCT", r"code g[ée]n[ée]ral des collectivit[ée]s territoriales|\bCGCT\b"),
    ("Urbanisme", r"code de l[’']urbanisme"),
    ("CGI", r"code g[ée]n[ée]ral des imp[ôo]ts|\bCGI\b"),
    ("Commande publique", r"code de la commande publique"),
    ("Environnement", r"code de l[’']environnement"),
    ("Fonction publique", r"code g[ée]n[ée]ral de la fonction publique|\bCGFP\b"),
    ("Voirie routière", r"code de la voirie routi[èe]re"),
    ("Patrimoine", r"code du patrimoine"),
    ("Forestier", r"code forestier"),
]
ARTICLE = (r"\barticles?\s+([LRD]\s?\.?\s?\d{1,4}(?:[-‑]\d+){0,3}"
           r"(?:\s*(?:et|à)\s*[LRD]?\s?\d[\d\-‑]*)?)")
ACT = r"\b(loi|décret|ordonnance|arrêté)\s+(?:n°\s*)?(\d{2,4}-\d+)"
BUDGET_INSTRUCTION = r"\bM\s?(?:14|57|4\d)\b"
CODE_WINDOW_AFTER, CODE_WINDOW_BEFORE = 160, 80

# --- Fixed values: exceptions, rule wording, follow-ups ------------------------------------------------
EXCEPTION = r"\bd[ée]rog\w*|\bexception\w*|à titre (?:exceptionnel|dérogatoire)|par exception"
ACCOUNTING_EXCEPTIONAL = (r"(?:charges?|produits?|résultats?|recettes?|dépenses?|opérations?)"
                          r"\s+exceptionnel")
RULE_WORDING = (
    r"en application d(?:e|u|es|’|')|conformément (?:à|au|aux)|en vertu d|r[ée]glementation|"
    r"r[ée]glementaire|législati|obligatoire|obligation|plafond|plafonn|contrôle de légalité|"
    r"\bpréfet|préfecture|loi de finances|selon les règles|imposé|imposent|à titre dérogatoire|"
    r"doit être (?:voté|approuvé|délibéré)")
FOLLOWUPS = [
    ("authorisation", r"autorise\w*\s+(?:Monsieur\s+|M\.\s*|Madame\s+)?(?:le|la)\s+Maire\s+à|"
                      r"donne\s+(?:tout\s+)?pouvoir|mandate\w*"),
    ("deferred", r"\breport[ée]e?s?\b|sera\s+(?:étudi|revu|reprogramm|soumis|inscrit|discut|"
                 r"reprécis)\w*|à l[’']ordre du jour d[’'e]\s*(?:une\s+)?prochaine?|"
                 r"prochain(?:e)?\s+(?:conseil|séance|réunion)|ultérieurement|en attente|"
                 r"à revoir|à l[’']étude|à étudier"),
    ("planned", r"\b(?:sera|seront)\s+(?:contact|sollicit|demand|lanc|réalis|engag|mis|prévu|"
                r"organis|présent)\w*|va être\s+\w+|à prévoir|\bun devis (?:sera|est à)"),
]
ACCOUNTING_CARRY = (r"(?:résultat|déficit|excédent|solde|crédits?|restes?|reste à réaliser|"
                    r"montant)\s+(?:de\s+\w+\s+)?(?:à\s+)?report")

# --- Fixed values: topics ---------------------------------------------------------------------------------
TOPICS = [
    ("finances", r"budget|d[ée]cision modificative|compte (?:administratif|financier)|affectation|"
                 r"emprunt|tr[ée]sorerie|recettes|d[ée]penses|fiscalit|taux d.imposition|taxe"),
    ("subventions", r"subvention"),
    ("urbanisme", r"\bPLU\b|urbanisme|permis de (?:construire|démolir)|zonage|cadastr|parcelle|"
                  r"bien (?:présumé )?sans maître|alignement"),
    ("droit de préemption", r"pr[ée]emption|\bDIA\b|d[ée]claration d.intention d.ali[ée]ner"),
    ("voirie et travaux", r"voirie|travaux|r[ée]fection|chaussée|\broute\b|\bchemin\b|toiture|"
                          r"r[ée]novation|assainissement|\beau\b|r[ée]seau"),
    ("patrimoine, culture, tourisme", r"patrimoine|culture|tourisme|touriste|cyclotourisme|"
                                      r"signal[ée]tique|ateliers? d.art|manufacture"),
    ("personnel", r"\bagents?\b|\bposte\b|adjoint|indemnit|centre de gestion|recrutement|"
                  r"contractuel|prévoyance|compl[ée]mentaire sant[ée]"),
    ("intercommunalité", r"communauté d.agglom|syndicat|intercommunal|\bSDIS\b|\bPETR\b"),
    ("environnement et risques", r"for[êe]t|incendie|d[ée]broussaill|inondation|risque|"
                                 r"environnement|biodiversit"),
    ("école et enfance", r"[ée]cole|\bALSH\b|cantine|p[ée]riscolaire|scolaire|enfance|jeunesse"),
    ("vie institutionnelle", r"commission|d[ée]l[ée]gu[ée]|procès[- ]verbal|\bPV\b|"
                             r"règlement int[ée]rieur|secr[ée]tariat de séance|élection|"
                             r"démission|représentant"),
    ("associations et vie locale", r"association|f[êe]te|manifestation|march[ée]|"
                                   r"salle des f[êe]tes|location de salle"),
]
UNWATCHED_TOPICS = ["droit de préemption", "vie institutionnelle"]
SALE_MARKERS = (r"pr[ée]emption|\bDIA\b|intention d.ali[ée]ner|d[ée]signation du bien|bien vendu|"
                r"prix de vente|offre d.achat|mise en vente|mise [àa] prix|"
                r"notaire charg[ée] de la vente|\b(?:vendeur|acqu[ée]reur)s?\s*(?:\(s\))?\s*:")
SALE_TITLE = r"\b(?:vente|cession|vendre|ceder)\b"
ADDRESS_TITLE = r"^\s*(?:\d{5}\b|.*\(\d{5}\)\.?\s*$)"
NEUTRAL_SALE_TITLE = "[transaction immobilière : détails omis]"

# --- Fixed values: places ------------------------------------------------------------------------------------
STREET_TYPES = (r"rue|chemin|place|impasse|avenue|route|ruelle|quai|boulevard|passage|cours|allée|"
                r"esplanade|côte|traverse|carrefour|faubourg|ancien chemin")
PLACE_STOP = ["cadastré", "cadastrée", "cadastrés", "pour", "où", "qui", "est", "sera", "et", "à",
              "au", "afin", "avec", "dans", "sur", "sous", "soit", "ainsi", "ce", "cette", "ces",
              "le", "la", "les", "un", "une", "ont", "a", "par", "vers", "lors", "dont", "que",
              "suite", "aux", "ou", "n"]
PLACE_PARTICLES = ["de", "du", "des", "la", "le", "les", "l", "d", "en", "au", "aux", "et"]
PLACE_TYPE_WORDS = ["rue", "chemin", "place", "impasse", "avenue", "route", "ruelle", "quai",
                    "boulevard", "passage", "cours", "allee", "esplanade", "cote", "traverse",
                    "carrefour", "faubourg", "ancien", "lieu", "dit", "rural", "communal",
                    "departementale"]
AMBIGUOUS_PLACE_TYPES = ["chemin", "route", "place", "cours", "passage", "traverse", "carrefour",
                         "lieu", "ancien"]
LANDMARKS = ["eglise", "mail", "halle", "mairie", "ecole", "source", "fontaine", "lavoir", "pont",
             "foyer", "cimetiere", "moulin"]
MIN_PLACE_SCORE = 0.5

# --- Fixed values: titles and linking ------------------------------------------------------------------------
TITLE_ARTICLES = ["du", "de", "des", "la", "le", "les", "au", "aux", "et", "un", "une", "en", "d",
                  "l"]
TITLE_ACRONYMS = ["pv", "plu", "ccas", "alsh", "cfu", "dia", "tva", "cgct", "sdis", "siap",
                  "epci", "rgpd", "abf"]
STOP_TERMS = """avec dans pour cette cela ainsi alors donc leur leurs elles nous vous sont sera
seront etre avoir fait faire font plus moins tout tous toute toutes entre depuis comme aussi autre
autres meme celui celle ceux sans sous sur vers lors dont ils elle ont ete etait etaient peut doit
doivent faut quand lorsque tres bien encore notamment suite afin cet ces son ses mais car puis
ensuite apres avant pendant selon chez lui eux soit voir pas non oui""".split()
CIVIC_TERMS = """conseil conseils municipal municipale commune communes maire monsieur madame
mairie vote votes unanimite majorite abstention deliberation seance point points propose
proposition propos approuve approuver valide valider decide decider autorise autoriser euros euro
conseiller conseillere adjoint adjointe presente presenter membres delegue signature article
demande demandes dossier question informe indique precise explique rappelle""".split()
STANDING_TITLE = (r"approbation|proces verbal|questions diverses|informations diverses|"
                  r"droit.? preemption|preemption")
TABLE_TITLE = (r"fonctionnement|investissement|recettes|depenses|section|total|"
               r"budget (?:general|ccas|lotissement|groupe)")
NOT_ACRONYMS = ["HT", "TTC", "TVA", "PDF", "EUR", "DIA"]
LINK_THRESHOLD, RARE_ACRONYM_DF, ACRONYM_MIN_COUNT, ACRONYM_WEIGHT = 0.30, 12, 2, 3
MIN_MEETINGS_AFTER = 2

# --- Fixed values: privacy --------------------------------------------------------------------------------------
PLACEHOLDER, PLACEHOLDERS = "[name withheld]", "[names withheld]"
ORG_WORDS = ["safer", "sci", "sarl", "sas", "sa", "eurl", "earl", "gaec", "scea", "commune",
             "mairie", "departement", "etat", "region", "syndicat", "association", "societe",
             "indivision", "consorts", "ccas"]
PRIVATE_FIELD = r"((?:Vendeur|Acqu[eé]reur|Propri[eé]taire)s?(?:\(s\))?)\s*:\s*([^\n]*)"
NAME_STOP = (r"(?:Monsieur|Madame|Mademoiselle|Mme|Mmes|Mlle|Mr|Mrs|MM|M|le|la|les|l|Maire|Maires|"
             r"Adjoint|Adjointe|Adjoints|Président|Présidente|Conseil|Conseiller|Conseillère|"
             r"Conseillers|Trésorier|Trésorière|Secrétaire|Directeur|Directrice|Vice|Délégué|"
             r"Déléguée|Habitant|Habitante)")
NAME_WORD = r"(?!(?iu:" + NAME_STOP + r")(?![\p{L}\p{N}_]))[A-ZÀ-Ý][\p{L}\p{N}_’'\-]+"
TITLES = r"M\.|MM\.|Mme|Mmes|Mlle|Mlles|Mr|Me|Mes|Monsieur|Madame|Mademoiselle|Messieurs|Mesdames"
HONORIFIC = r"(?:Monsieur|Madame|Mademoiselle|M\.|Mme|Mlle|Mr\.?)"
PRESENT_LIST = (r"[ée]taient?\s+pr[ée]sents?\s*:?\s*(.+?)(?=[ée]taient?\s+(?:absents?|excus)|"
                r"la séance est ouverte|secr[ée]tariat|ordre du jour|$)")
ABSENT_LIST = (r"[ée]taient?\s+(?:absents?|excus[ée]s?)\s*:?\s*(.+?)(?=la séance est ouverte|"
               r"secr[ée]tariat|ordre du jour|$)")
ROSTER_LIST = (r"pr[ée]sents?\s*:?(.*?)(?=secr[ée]tariat|secr[ée]taire|ordre du jour|"
               r"monsieur le maire|la s[ée]ance|$)")
PROXY = r"\s*(?:procuration|pouvoir)\s+à\s+"
CHAIR = (r"[Pp]r[ée]sidence\s+(?:de\s+(?:Monsieur|Madame|M\.|Mme)\s+|"
         r"du\s+Maire,?\s+(?:M\.|Monsieur|Madame|Mme)\s+)([^,.]{3,60}?)\s*(?:,|\.|\s+Maire)")
FIGURE_CATEGORIES = ["elected_official", "business_owner", "other_public_figure"]
COMMON_MIN_COUNT = 3
ROSTER_FILLER = """presents present absents absent excuses excuse excusee procuration
procurations a au de du des et la le les par pour contre abstention secretaire mme mmes mr mrs
mlle monsieur madame mademoiselle mesdames messieurs""".split()

# --- Fixed values: dates -------------------------------------------------------------------------------------------
MONTHS = {"janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
          "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11,
          "décembre": 12, "decembre": 12}
DATE_HORIZON_DAYS, WATCH_DAYS = 400, 360

# --- Fixed values: ledger rules (account prefixes in / out, side) ------------------------------------------------
LEDGER_RULES = [
    ("revenue", "credit", ["70", "73", "74", "75", "76", "77"], ["775", "776", "777"]),
    ("spending", "debit", ["60", "61", "62", "63", "64", "65", "66", "67"], ["675", "676"]),
    ("staff", "debit", ["64"], []),
    ("interest", "debit", ["66"], []),
    ("taxes", "credit", ["73"], []),
    ("state", "credit", ["74"], []),
    ("investment", "flow", ["20", "21", "23"], []),
    ("debt", "credit", ["16"], ["165", "1688", "169"]),
]

# --- Fixed values: lines and blocks -----------------------------------------------------------------------------------
BULLET = r"^\s*(?:[-–—•➢►▪>*]|\d{1,2}[.)])\s+"
TABLE_AMOUNT = r"-?\d{1,3}(?: \d{3})+(?:,\d+)?|-?\d+,\d+"
SENTENCE_END = r"[.:;!?)»”\"]$"

# --- Fixed values: generated-text checks ---------------------------------------------------------
STOP_WORDS = {
    "fr": ["le", "la", "les", "des", "du", "est", "une", "dans", "pour", "sur", "au", "aux",
           "que", "qui", "et"],
    "en": ["the", "of", "and", "to", "is", "in", "for", "on", "with", "that", "by", "are", "was"],
    "nl": ["de", "het", "een", "van", "en", "dat", "is", "voor", "op", "met", "te", "niet",
           "zijn", "wordt"],
}
# Two further languages for corpora that hold them (not part of the default check).
EXTRA_STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "auf", "ein", "eine", "von", "zu"],
    "es": ["el", "los", "las", "una", "y", "en", "que", "por", "con", "para", "del", "es"],
}
FRENCH_FUNCTION_WORDS = """le la les des du un une pour dans au aux avec cette ces ses leur sont
est il qui et elle elles nous vous sur par ou""".split() + ["été"]
OTHER_FUNCTION_WORDS = """the of and to in is are for with on that this by an as it be was were
from at or not which their its has have het een van op te dat die voor met zijn niet aan er door
als ook bij naar of dit deze worden werd""".split()
NUMBER = r"\d[\d\s .,]*\d|\d"
PREAMBLE = (r"^\s*(?:here is|here's|voici|translation\s*:|de vertaling|hier is|sure|certainly)")
CITATION = r"\[p\.\s*\d+(?:\s*[-–]\s*\d+)?\]"
LEGAL_REF_SHORT = r"[LRD]\s?\d{3,4}(?:-\d+)+"

# --- Fixed values: parcels ------------------------------------------------------------------------
PARCEL_INLINE = (r"(?iu:cadastr[ée]e?s?)\s*(?:section\s*)?([A-ZÆ]{1,2})\s*(?:n°\s*)?0*(\d{1,4})"
                 r"(?![\p{L}\p{N}_])")
PARCEL_TABLE = r"\|\s*([A-ZÆ]{1,2})\s*\|\s*0*(\d{1,4})\s*\|"
PARCEL_BARE = r"(?<![\p{L}\p{N}_])([A-Z]{2})\s?0(\d{3})(?![\p{L}\p{N}_])"
PARCEL_STACK = r"(?i)Superficie totale\s*\n((?:[^\n]*\n)+?)\s*Usage"

# --- Fixed values: captures, search, rate limit -----------------------------------------------------
FORMAT_RANK = ["application/pdf", "text/html", "text/rtf", "application/msword"]
MINUTES_FILE = r"(?i)/(?:docs/|conseil/)?CRCM[^/]*\.(pdf|doc|rtf|html?)$"
BM25_K1, BM25_B = 1.2, 0.75
RATE_LIMIT_HITS, RATE_LIMIT_SECONDS = 30, 60
MIN_TEXT_CHARS, IMAGE_HEAVY_FRACTION, IMAGE_HEAVY_MAX_CHARS = 50, 0.25, 300
BATCH_CHARS, BATCH_ITEMS = 2500, 12

# ---- fixed values: how dates and places are written; the patterns decide what is found -------------------------------

_WORD = r"[\p{L}\p{N}_]"
_END = rf"(?!{_WORD})"
_MONTH = "|".join(MONTHS)
# years after two thousand: the words of DATE_NUMBER_WORDS, the longest first, with the compounds of ten and twenty
_YEAR = "|".join([*(f"dix-{w}" for w in ("sept", "huit", "neuf")), r"vingt(?:\s+et\s+un)?", "zéro",
                  *sorted((w for w, n in DATE_NUMBER_WORDS.items() if n < 20 and w != "premier"), key=len, reverse=True)])
SPOKEN_DATE = rf"(?iu)(?<!{_WORD})(\d{{1,2}}|1er)\s+({_MONTH})(?:\s+(20\d{{2}}))?{_END}"
LONG_DATE = rf"(?iu)(?<!{_WORD})(\d{{1,2}})(?:er)?\s+({_MONTH})\s+(20\d{{2}}){_END}"
HEADER_DATE = rf"(?iu)(?<!{_WORD})CONSEIL\s+MUNICIPAL\s+DU\s+(\d{{1,2}})/(\d{{1,2}})/(20\d{{2}}){_END}"
FORMULA_DATE = (rf"(?iu)L\s*['’]?\s*an\s+deux\s+mil(?:les?)?\s+({_YEAR})\s+et\s+le\s+"
                r"(\d{1,2}|premier|[a-zéû]+(?:[\s-]+(?:et[\s-]+)?[a-zéû]+)?)(?:\s+du\s+mois)?\s+"
                rf"(?:d['’]\s*|de\s+)?({_MONTH}){_END}")
_NAME = r"[\p{L}\p{N}_’'\-]+"
STREET = (rf"(?<!{_WORD})(\d{{1,3}}\s*(?:bis|ter)?\s+)?({STREET_TYPES})\s+"
          rf"((?:(?:de la|de l[’']|du|des|de|d[’'])\s*)?{_NAME}(?:\s+{_NAME}){{0,3}})")
HAMLET = (rf"(?<!{_WORD})(?iu:lieux?[\s-]?dits?)\s+(?iu:de la |de l[’']|du |des |de |d[’'])?[«“\"]?\s*"
          rf"([A-ZÀ-Ý]{_NAME}(?:\s+[A-ZÀ-Ý]{_NAME}){{0,2}})")
PLACE_MODIFIERS = ["rural", "rurale", "communal", "communale", "departementale", "ancien", "ancienne"]
PLACE_LINKS = ["de", "du", "des", "d", "l", "la", "le", "les"]
