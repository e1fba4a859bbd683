"""Label taxonomy, places, dialect markers, sound rules and cleaning tables.

Results depend on these words, patterns and numbers, so they are required to be what they are.
"""

from __future__ import annotations

FAMILIES = ("greater_polish", "lesser_polish", "masovian", "silesian", "kashubian", "standard")
LEVELS = ("family", "dialect", "region", "village", "voivodeship")
UNLABELLED = "__unlabelled__"

FAMILY_OF = {
    "kurpie": "masovian", "podhale": "lesser_polish", "spisz": "lesser_polish", "orawa": "lesser_polish", "kashubia": "kashubian",
    "kociewie": "greater_polish", "kujawy": "greater_polish", "warmia": "masovian", "masuria": "masovian", "podlasie": "masovian",
    "silesia": "silesian", "cieszyn_silesia": "silesian", "greater_poland": "greater_polish", "lesser_poland": "lesser_polish",
    "mazovia_proper": "masovian", "podolia": "lesser_polish",
}

#: Latitude and longitude.
DIALECT_PLACES = {
    "kurpie": (53.25, 21.35), "podhale": (49.35, 19.95), "spisz": (49.42, 20.42), "orawa": (49.52, 19.72), "kashubia": (54.25, 18.0),
    "kociewie": (53.95, 18.55), "kujawy": (52.75, 18.55), "warmia": (53.95, 20.45), "masuria": (53.85, 21.55), "podlasie": (53.1, 23.0),
    "silesia": (50.3, 18.7), "cieszyn_silesia": (49.75, 18.63), "greater_poland": (52.3, 17.3), "lesser_poland": (50.05, 20.5),
    "mazovia_proper": (52.4, 21.0), "podolia": (49.25, 27.35),
}
VOIVODESHIP_PLACES = {
    "dolnoslaskie": (51.1, 16.4), "kujawsko-pomorskie": (53.05, 18.5), "lubelskie": (51.2, 22.9), "lubuskie": (52.2, 15.3), "lodzkie": (51.6, 19.4),
    "malopolskie": (49.9, 20.4), "mazowieckie": (52.35, 21.1), "opolskie": (50.6, 17.9), "podkarpackie": (50.05, 22.0), "podlaskie": (53.3, 23.0),
    "pomorskie": (54.2, 18.0), "slaskie": (50.3, 19.0), "swietokrzyskie": (50.8, 20.8), "warminsko-mazurskie": (53.9, 20.8), "wielkopolskie": (52.3, 17.3),
    "zachodniopomorskie": (53.6, 15.5),
}

MARKERS = {
    "podhale": [
        "kaj", "ka", "hej", "baca", "juhas", "holny", "ciupaga", "gazda", "watra", "dutki",
    ],
    "silesia": [
        "godać", "godo", "jo", "żech", "kaj", "bajtel", "fana", "richtig", "gryfny", "frelka", "pieron", "niy",
    ],
    "kashubia": [
        "jo", "kaszëbë", "chëcz", "białka", "brutka", "wiedno",
    ],
    "kurpie": [
        "psiwo", "psies", "jesce", "cego", "kobzieta", "bziały",
    ],
    "greater_poland": [
        "tej", "wuchta", "szneka", "pyry", "bimba", "gzik", "bejmy", "blubrać",
    ],
    "masovia": [
        "chojak", "sośnia", "gula", "latoś",
    ],
}
#: Standard words with a soft-labial cluster.
SOFT_LABIAL_STOP = [
    "psi", "psia", "psie", "psią", "psiej", "psiego", "psiemu", "psim", "psich", "psimi", "psina", "psisko", "psiarnia", "psikus", "bzik",
    "bzika", "bzie", "wziąć", "wziął", "wzięła", "wzięło", "wzięli", "wzięły", "wzięty", "wzięta", "wzięte", "wziętą", "wzięci", "wzięcie",
    "wziąwszy", "wziernik", "mnie", "mniej", "mniejszy", "mniejsza", "mniejsze", "mniejszą", "mniejszych", "mniejszym", "mniejszości",
    "mniejszość", "mnich", "mnicha", "mnisi", "mniszka", "mniemanie", "mniemać", "pomnik", "pomnika", "pomniki", "pomników", "wspomnienie",
    "wspomnień", "wspomnieć", "przypomnieć", "przypomnienie", "upomnienie", "zapomnieć", "zapomnienie", "ziemniak", "ziemniaki",
    "ziemniaka", "ziemniaków", "ziemniakami", "ziemniakach", "ziemniakiem", "ziemniakom",
]
SOFT_LABIAL_PATTERN = "psi|bzi|wzi|mni"
SIBILANT_DIGRAPHS = ("dż", "cz", "sz", "ż")

#: name: (families, detectable, final only, standard -> dialect, words left alone)
RULES = {
    "mazurzenie": (("masovian", "lesser_polish"), False, False, (("dż", "dz"), ("cz", "c"), ("sz", "s"), ("ż", "z")), ()),
    "soft_labials": (("masovian",), True, False, (("pi", "psi"), ("bi", "bzi"), ("wi", "wzi"), ("mi", "mni")), tuple(SOFT_LABIAL_STOP)),
    "silesian_final_ch": (("silesian",), False, True, (("ch", "k"),), ()),
    "kaszubienie": (("kashubian",), False, False, (("dź", "dz"), ("ć", "c"), ("ś", "s"), ("ź", "z")), ()),
}

DOUBLE_QUOTES, SINGLE_QUOTES, DASHES = "„“”‟«»", "‘’‚‛‹›", "‒–—―−"
ANNOTATIONS = (
    r"[sś]miech\w*", r"niezrozumia\w*", r"pauza\w*", r"przerwa\w*", r"ha[lł]as\w*", r"kaszel|kas[lł]e\w*", r"wzdych\w*", r"p[lł]acz\w*", "cisza", r"szum\w*",
    "oklaski", r"[sś]piew\w*", r"chrz[aą]k\w*", r"laugh\w*", "pause", "noise", "inaudible", "unintelligible", r"cough\w*",
)
#: Cleaning patterns: bracketed notes, pause marks, runs of full stops, repeated marks.
BRACKETED = r"\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>"
PARENTHESISED = r"\(\s*(?:{})[^()]*\)|\(\s*[.\-*\s]+\)"
PAUSE = r"(?<!\S)(?:-+|\.{3,}|…)(?!\S)"
LONG_STOPS, REPEATED_MARKS = r"\.{4,}", r"([!?,;:])\1+"
#: Marks that stylometry counts.
STYLE_DASHES, STYLE_QUOTES = "-–—", "\"'„”“«»‘’‚"
AGE_BANDS = ((19, "<=19"), (29, "20-29"), (44, "30-44"), (59, "45-59"))
LENGTH_BANDS = ((40, "<=40"), (80, "41-80"), (160, "81-160"))
