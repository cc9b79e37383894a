"""Language identification by compression with per-language dictionaries.

Each language has a raw-content zstandard dictionary cut from its training
texts. A text is encoded with every dictionary, piece by piece, and the
language with the smallest total wins; if the runner-up is nearly as small,
the text is rejected. Pieces keep the dictionary in reach over the whole of a
long text, whose own repetitions would otherwise outweigh it.

Texts are lower-cased and cut to letters and single spaces before either use.

Training reads a bounded sample: for each language at most ``sample`` texts
(different ones, those with the smallest hash), of which at most ``share_bytes``
bytes each enter a dictionary of at most ``dict_bytes``. Of the sample, lines
that several languages share go, then texts whose label the dictionaries of
the sample's other half do not confirm. At most ``languages``
languages, the most frequent, are learnt. Prediction reads whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and are rejected; so is everything if nothing was learnt. Null labels are not
learnt. Of equal sizes the language first in sort order wins, with score 0.
"""

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabcast.llm import words

UNKNOWN = "und"
SAMPLE = 400
SHARE_BYTES = 1_000
DICT_BYTES = 110_000
LANGUAGES = 200
PIECE = 4_096
LEVEL = 6
# The runner-up must be larger by this share of the best size, or the text is rejected.
MARGIN = 0.002
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased letters with one space for everything between them."""
    return _OTHER.sub(" ", text.lower()).strip()


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, share_bytes: int = SHARE_BYTES, dict_bytes: int = DICT_BYTES, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Dictionary content of each language, from a bounded sample of the labelled texts."""
    rows = docs.select(docs[label_col].cast("string").alias("lang"), docs[text_col].alias("text")).where("lang is not null and text is not null")
    # Copies pass the threshold together, so it follows the number of different texts.
    texts_of = rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.count("*").alias("n"))
    counted = texts_of.groupBy("lang").agg(F.sum("n").alias("rows"), F.count("*").alias("texts")).orderBy(F.desc("rows"), "lang").limit(languages).collect()
    if not counted:
        return {}
    # About twice the sample passes the hash threshold, so that ranking sees a bounded number of texts.
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    limit = F.create_map(*[x for r in counted for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * (sample + 50) / r["texts"])))])
    few = rows.withColumn("place", place).where(F.col("place") <= limit[F.col("lang")])
    # Copies of one text have one place; they are learnt once.
    few = few.select("lang", "place", F.substring("text", 1, share_bytes).alias("text")).distinct()
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).where(F.col("n") <= sample)
    texts: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "n").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return _dictionaries(_consistent(_own_lines(texts), dict_bytes), dict_bytes)


def _own_lines(texts: dict[str, list[str]]) -> dict[str, list[str]]:
    """Texts without the lines that samples of several languages hold: boilerplate tells no language."""
    seen: dict[str, set[str]] = {}
    for lang, some in texts.items():
        for line in {line for text in some for line in text.split("\n")}:
            seen.setdefault(line, set()).add(lang)
    own = {lang: ["\n".join(line for line in text.split("\n") if len(seen[line]) == 1) for text in some] for lang, some in texts.items()}
    return {lang: [letters(text) for text in some] for lang, some in own.items()}


def _dictionaries(parts: dict[str, list[str]], dict_bytes: int) -> dict[str, bytes]:
    return {lang: " ".join(some).encode()[-dict_bytes:] for lang, some in sorted(parts.items()) if any(some)}


def _consistent(parts: dict[str, list[str]], dict_bytes: int) -> dict[str, list[str]]:
    """The texts that dictionaries of the other half give their own label; wrong labels and mixtures go."""
    out: dict[str, list[str]] = {lang: [] for lang in parts}
    for half in (0, 1):
        judge = Classifier(_dictionaries({lang: some[1 - half :: 2] for lang, some in parts.items()}, dict_bytes))
        for lang, some in parts.items():
            mine = some[half::2]
            kept = [text for text in mine if judge.classify(text)[0] == lang]
            # A language too rare to judge keeps what it has.
            out[lang] += kept if lang in judge.names else mine
    return {lang: kept or parts[lang] for lang, kept in out.items()}


class Classifier:
    def __init__(self, contents: dict[str, bytes], level: int = LEVEL, piece: int = PIECE, margin: float = MARGIN):
        self.names = sorted(contents)
        self.piece, self.margin = piece, margin
        self.coders = []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=data, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, clean: bytes) -> list[int]:
        pieces = [clean[i : i + self.piece] for i in range(0, len(clean), self.piece)]
        return [sum(len(coder.compress(p)) for p in pieces) for coder in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); the score grows with the margin, 0 to 1."""
        clean = letters(text or "")
        if not any(map(str.isalpha, clean)) or not self.coders:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(clean.encode())
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        if not others:
            return self.names[best], 1.0, False
        gap = (min(others) - sizes[best]) / sizes[best]
        return self.names[best], 1 - math.exp(-10 * gap), gap < self.margin


_TYPE = "struct<lang_pred:string,score:double,rejected:boolean>"
_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def classify_column(text: Column, contents: dict[str, bytes], context=None, **settings) -> Column:
    """Struct (lang_pred, score, rejected) of a text; ``context`` broadcasts the bounded dictionaries."""
    held = context.broadcast(contents) if context is not None else None

    @F.arrow_udf(_TYPE)
    def classified(column: pa.Array) -> pa.Array:
        known = Classifier(held.value if held is not None else contents, **settings)
        found = [known.classify(raw and raw.decode()) for raw in words.raw_texts(column)]
        return pa.array([dict(zip(("lang_pred", "score", "rejected"), x)) for x in found], _ARROW)

    return classified(text)


def identify(docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, lang_pred, score, rejected) of every document."""
    found = classify_column(docs[text_col], contents, docs.sparkSession.sparkContext, **settings)
    return docs.select(docs[id_col], found.alias("_found")).select(id_col, "_found.*")


def accepted(docs: DataFrame, contents: dict[str, bytes], text_col: str = "text", **settings) -> DataFrame:
    """The documents whose language is told with a clear margin."""
    found = classify_column(docs[text_col], contents, docs.sparkSession.sparkContext, **settings)
    return docs.where(~found["rejected"])
