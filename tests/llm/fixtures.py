"""Small tables and plain-Python counterparts the operators are compared with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id BIGINT, text STRING, lang STRING, signature STRING, key INT, _gone INT, rest STRING"


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(LOWER))


def documents(spark, texts, first=0):
    """Documents with columns whose names the operators use themselves."""
    rows = [(first + i, t, "en", "x", i, i, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def changed(tokens, at, by="CHANGED"):
    return [by if i in at else t for i, t in enumerate(tokens)]


ODD = [None, "", "   \n\t ", "one", "Two words", "É è\nü", "long " * 30000, "a\nb\n\nc"]
