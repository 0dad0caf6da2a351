"""Small tables with every awkward case, and plain Python versions of the operators' contracts."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "re", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(n=120, seed=1):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(n)]
    copies = [texts[3]] * 40  # a third of all rows are copies of one text
    near = [texts[5] + " " + prose(rng, 1) for _ in range(10)]
    spaced = [texts[7].replace(" ", "\n\t ") + "  ", texts[7] + "\x0b"]
    odd = [None, "", None, "   \n", "x", prose(rng, 30_000), "é\u00a0ü\x1c\x85 ünïcode 😀 text", texts[9], texts[9]]
    rows = [(i, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"s{min(i % 9, 3)}", None) for i, t in enumerate(texts + copies + near + spaced + odd)]
    return rows + [rows[4], rows[4], (None, "no id at all", None, None, None), (None, texts[3], "en", None, 3)]
