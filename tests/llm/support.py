"""Small fixtures and plain versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=120, seed=3):
    """Invented texts with copies, near copies, shared lines, junk and the awkward cases."""
    rng = random.Random(seed)
    words = {"en": ["the", "and", "house", "tree", "walking", "water", "seven", "light"], "de": ["der", "und", "haus", "baum", "gehen", "wasser", "sieben", "größe"]}
    pool = [f"w{i}x" for i in range(300)]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        body = [rng.choice(words[lang] + pool[:60] if i % 3 else words[lang]) for _ in range(rng.randint(1, 120))]
        body = [rng.choice(pool) if rng.random() < 0.4 else w for w in body]
        text = "\n".join(" ".join(body[k : k + 12]) for k in range(0, len(body), 12))
        rows.append((i, text, lang, f"s{i % 4}" if i % 9 else None, len(text)))
    for k in range(30):
        i = rng.randrange(n)
        text = rows[i][1].split(" ")
        for _ in range(k % 4):
            text[rng.randrange(len(text))] = f"edit{k}"
        rows.append((n + k, " ".join(text), rows[i][2], rows[i][3], None))
    odd = [None, "", "   \n\t", "One", "One two", "a b c d e", "A B C D E", "one two three four five six seven eight " * 6, "ünïcode ﬁ 漢字 🎉 " * 12, "x" * 5000, "the house " * 4000, "<|endoftext|> mid<|endoftext|>", "  lead\x0b\x0c\rand\x85nbsp sep  "]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(odd)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, rows[7][1], "en", "s1", 3))
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)
