"""Small corpora and plain reference versions."""

import random
import re

SYLLABLES = {
    "en": "the th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "fr": "le la de et les des en un une du que est pour qui dans é è ê ç eux aux elle ment tion ou ai on".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein ü ö ä ß sch ch ung heit keit".split(),
}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def lower(text):
    return (text or "").translate(_LOWER)


def prose(rng, lang="en", words=60):
    s = SYLLABLES[lang]
    out = []
    while len(out) < words:
        n = rng.randint(4, 12)
        line = ["".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(n)]
        out += [line[0].capitalize(), *line[1:-1], line[-1] + "."]
    return " ".join(out)


def rng(seed=5):
    return random.Random(seed)


#: Texts that every operator has to stand.
ODD = [None, "", " \t\n", "x", "...!!!", "Ünï çödé", "\u0000   \U0001f600", "a b c d e f g h", "a b c d e f g h"]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, sources=None, first=0):
    rows = [(first + i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
