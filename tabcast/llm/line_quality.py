"""Quality rules line by line first, then on the document.

Every line that holds a word is judged by three rules; lines that fail one
go. A document that fails a base rule, or loses more than ``MAX_LOST`` of the
code points of its words with those lines, is rejected.

* punctuation: no word of the line ends a sentence, or more than one in ten
  of the code points of its words is a symbol of ``SYMBOLS``;
* navigation: one word in four or more is only separators, or the line has
  at most ``SHORT`` words and holds a phrase of ``NAVIGATION``;
* boilerplate: the line holds a phrase of ``BOILERPLATE``, or equals an
  earlier line of its text.

Phrases are met over lower-cased runs of digits, letters and non-ASCII
characters. Each text is judged in its task alone; nothing is shuffled.

Defined cases: a null or empty text has no words, fails the base rules and
leaves an empty text; lines without a word are kept between kept lines and
count nowhere; repeated rows get equal results; extra columns ride along.
"""

import re
from dataclasses import astuple, dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcast.llm import words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_LOST_PERCENT = 30
SHORT = 10

# Characters and phrases of the rules.
SYMBOLS = "#*$%&|<>"
NAVIGATION = [
    "about us", "add to cart", "back to top", "click here", "contact us", "continue reading", "home page", "items in cart",
    "leave a comment", "log in", "log out", "main menu", "next page", "older posts", "previous page", "read more", "sign in",
    "sign up", "site map", "skip to content", "share this", "view all",
]
BOILERPLATE = [
    "accept cookies", "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled", "lorem ipsum",
    "powered by", "privacy policy", "requires javascript", "subscribe to our newsletter", "terms of service", "terms of use",
    "this site uses cookies", "use of cookies", "uses cookies", "we use cookies",
]
# A mark behind which a sentence may end, with closing quotes and brackets; wide marks need no space behind them.
SENTENCE_END = r"""(?:[.!?:;]|…)(?:["')\]]|”|’|»)*(?:[ \t\n\v\f\r]|$)|。|！|？|।|؟"""
SEPARATORS = r"(?:[-|/\\<>*+=~_]|»|«|›|‹|•|·|→|←|–|—)+"


def phrase_pattern(phrases: list[str]) -> str:
    """Any of the phrases as whole words, among words parted by one or more spaces."""
    return "(?:^| )(?:" + "|".join(p.replace(" ", " +") for p in phrases) + ")(?: |$)"


_END, _SEPARATOR = re.compile(SENTENCE_END.encode()), re.compile(SEPARATORS.encode())
_NAVIGATION, _BOILERPLATE = (re.compile(phrase_pattern(p).encode(), re.MULTILINE) for p in (NAVIGATION, BOILERPLATE))
_SYMBOLS = SYMBOLS.encode()
_LATER_BYTES, _SPACES = bytes(range(0x80, 0xC0)), b" \t\n\v\f\r"
# Words and lines stay, all else becomes a space.
_FOLDED_LINES = words.FOLDED[:10] + b"\n" + words.FOLDED[11:]


@dataclass
class Facts:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    n_lines: int = 0
    n_no_punctuation: int = 0
    n_navigation: int = 0
    n_boilerplate: int = 0
    n_failed_lines: int = 0
    lost_chars: int = 0


def _chars(raw: bytes) -> int:
    """Code points other than white space."""
    return len(raw.translate(None, _LATER_BYTES + _SPACES))


def _symbols(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, _SYMBOLS))


def repeated_words(found: list[bytes], width: int = WINDOW) -> int:
    """Words under a window of ``width`` words that stands at two or more places."""
    windows = words.window_hashes(words.word_hashes(found), width)
    if not len(windows):
        return 0
    _, group, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[group] > 1)
    if not len(starts):
        return 0
    # Each start covers its window, or as much as the next start leaves.
    return int(np.minimum(np.diff(starts), width).sum()) + width


def judge(raw: bytes | None) -> tuple[Facts, bytes]:
    """The facts of a text, and the text without the lines that fail."""
    raw = raw or b""
    found = words.space_words(raw)
    facts = Facts(len(found), _chars(raw), _symbols(raw), n_repeat_words=repeated_words(found))
    folded = raw.translate(_FOLDED_LINES)
    navigation, boilerplate = (bool(p.search(folded)) for p in (_NAVIGATION, _BOILERPLATE))
    plain = folded.split(b"\n") if navigation or boilerplate else None
    seen, kept = set(), []
    for i, line in enumerate(raw.split(b"\n")):
        own = words.space_words(line)
        if not own:
            kept.append(line)
            continue
        size, again = _chars(line), line in seen
        seen.add(line)
        unpunctuated = 10 * _symbols(line) > size or not _END.search(line)
        menu = (navigation and len(own) <= SHORT and bool(_NAVIGATION.search(plain[i]))) or (
            _SEPARATOR.search(line) is not None and 4 * sum(_SEPARATOR.fullmatch(w) is not None for w in own) >= len(own))
        stock = again or (boilerplate and bool(_BOILERPLATE.search(plain[i])))
        facts.n_lines += 1
        facts.n_dup_lines += again
        facts.n_no_punctuation += unpunctuated
        facts.n_navigation += menu
        facts.n_boilerplate += stock
        if unpunctuated or menu or stock:
            facts.n_failed_lines += 1
            facts.lost_chars += size
        else:
            kept.append(line)
    return facts, b"\n".join(kept)


_NAMES = [f.name for f in fields(Facts)]
_ARROW = pa.struct([*[(n, pa.int64()) for n in _NAMES], ("clean", pa.string())])
_TYPE = "struct<" + ", ".join(f"{n}: long" for n in _NAMES) + ", clean: string>"


def quality_column(text: Column) -> Column:
    """Struct of the facts of a whole text and ``clean``, the text without failed lines."""

    @F.arrow_udf(_TYPE)
    def judged(column: pa.Array) -> pa.Array:
        made = []
        for raw in words.raw_texts(column):
            facts, clean = judge(raw)
            made.append((*astuple(facts), clean))
        columns = list(zip(*made)) or [[]] * len(_ARROW)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], fields=list(_ARROW))

    return judged(text)


def assess(
    docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS,
    max_repeated: int = MAX_REPEATED_PERCENT, max_lost: int = MAX_LOST_PERCENT,
) -> DataFrame:
    """``row`` (the document) and ``found``: its facts, ``clean``, ``base_failed`` and ``kept``; limits are in percent."""
    judged = docs.select(F.struct("*").alias("row"), quality_column(docs[text_col]).alias("found"))
    fact = F.col("found")
    failed = (fact["n_words"] < min_words) | (100 * fact["n_repeat_words"] > max_repeated * fact["n_words"])
    lost = 100 * fact["lost_chars"] > max_lost * fact["word_chars"]
    return judged.withColumn("found", fact.withField("base_failed", failed).withField("kept", ~failed & ~lost))


def cleaned(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The documents that are kept, without their failed lines."""
    kept = assess(docs, text_col, **limits).where("found.kept")
    return kept.select(F.col("row").withField(text_col, F.col("found.clean")).alias("row")).select("row.*")
