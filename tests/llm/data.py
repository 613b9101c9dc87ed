"""Small documents with every awkward case."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, size string, h1 int, component string, score string, fp string"
WORDS = "the of and quiet river stone letter window garden yellow paper under morning little house water silver across table branch winter forest".split()


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choices(WORDS, k=k))
    shared = [line(12) for _ in range(3)]
    texts: list[str | None] = [None, "", " \n\t", "word", "A b C", "x" * 5000, "long " * 20000, "\n\n\n", "é ÉA ñ b\x1fc \U0001f600 中文 字", "<|endoftext|> it's 12 o'clock", "aaaa aaaa\naaaa", "!!! ### $$$ %%%"]
    for i in range(n):
        body = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), ("  " if i % 2 else "") + (shared[i % 9 // 3].upper() if i % 4 == 0 else shared[i % 9 // 3]) + "\t")
        texts.append("\n".join(body))
    texts += texts[-4:]  # exact copies
    texts += [t.replace("river", "stone", 1) for t in texts[-6:]]  # near copies
    langs, sources = ["en", "fr", None], ["a", "b", "c", None]
    out = [(i, t, langs[i % 3], "hot" if i % 3 == 0 else sources[i % 4], None if t is None else len(t), "clash", "clash", 7, "clash", "clash", "clash") for i, t in enumerate(texts)]
    out += [out[20], out[20], (None, "no id at all here", "en", "a", 3, *["clash"] * 2, 7, *["clash"] * 3), (None, None, None, None, None, None, None, None, None, None, None)]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
