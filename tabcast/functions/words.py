"""Vocabularies that decide a column's type, and type advice."""

# Substrings of a column name that hint at a date.
DATE_KEYWORDS = (
    "date", "time", "year", "month", "day", "annee", "mois", "jour",
    "periode", "semaine", "trimestre", "heure",
)

# Substrings of a column name that hint at an identifier.
ID_KEYWORDS = (
    "id", "code", "ref", "numero", "num", "no", "index", "identifiant",
    "matricule", "cle",
)

# A text column holding nothing else is binary.
BINARY_WORDS = (
    "0", "1", "oui", "non", "yes", "no", "true", "false", "vrai", "faux",
    "m", "f", "male", "female", "homme", "femme",
)

# One of these words makes a text column ordinal.
ORDINAL_WORDS = (
    "faible", "moyen", "fort", "élevé", "low", "medium", "high",
    "très faible", "très fort",
    "mauvais", "passable", "bien", "très bien", "excellent",
    "débutant", "intermédiaire", "avancé", "expert",
    "1er", "2ème", "3ème", "4ème", "5ème",
)

# Column names a projection fills from the future date.
YEAR_NAMES = ("year", "annee", "an")
MONTH_NAMES = ("month", "mois")
DAY_NAMES = ("day", "jour")

# Text cells a CSV reader takes as missing.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Label that stands for a missing value in the encoders.
MISSING_LABEL = "__NA__"

TYPE_LABELS = {
    "date": "Date or time",
    "binary": "Binary",
    "identifier": "Identifier",
    "categorical": "Categorical",
    "ordinal": "Ordinal",
    "continuous": "Continuous",
    "integer": "Integer",
    "text": "Free text",
}

TYPE_ADVICE = {
    "date": "split into calendar parts or use as the axis of a series",
    "binary": "compare the two groups or use as a class target",
    "identifier": "leave out of models",
    "categorical": "encode before modelling",
    "ordinal": "encode as ordered codes",
    "continuous": "use directly after checking spread and outliers",
    "integer": "use directly or cut into classes",
    "text": "leave out or turn into numbers first",
}
