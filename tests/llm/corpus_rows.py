"""Rows with the cases every corpus operator must define."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, _k1 long, item long"


def prose(rng, n, alphabet):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def make_rows(seed=5):
    rng = random.Random(seed)
    shared = [prose(rng, 60, "abcdeé") for _ in range(3)]
    line = "a line that many documents have\nand the next one, too"
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(1, 90), "abcdefghijé")]
        if i % 4 == 0:
            parts.append(shared[i % 3])
        if i % 5 == 0:
            parts.append(line)
        parts.append(prose(rng, rng.randint(1, 60), "klmnopqrst"))
        rng.shuffle(parts)
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(parts))
    for i in range(0, 40, 3):  # near copies: one word differs
        found = texts[i].split(" ")
        found[len(found) // 2] = "changed"
        texts.append(" ".join(found))
    texts += [texts[3], texts[3], texts[9], "", "", None, " \t\n ", "x", "one two", "a\n\n\nb\n\n\nb\n\n\nb", "12 345 !!", "tab\tand\vothers\x1fhere\x85there\xa0end"]
    texts.append(prose(rng, 30_000, "abcdefg"))
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 2}", None if t is None else len(t), "own", 7, 8, 9) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[4], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows
