"""Rows and plain versions that the tests of this folder share."""

import random
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, n string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang), with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, l, None, None, "x", None, "y") for i, t, l in rows], DOCS)


def words(n, seed=0, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


EDGES = [(1, None, None), (2, "", "en"), (3, "  \t\n ", "en"), (4, "one two", "en"), (4, "one two", "en"), (5, "ONE two", None), (None, "Ärger é 中文", "de"), (7, "123 !!", "en")]


def brute_components(rows, num=75, den=100):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:  # to a fixpoint
        before = dict(root)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and den * both >= num * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return {i: (len(sets[i]), root[i]) for i in sets}


def library_ids(name, texts):
    """ids of texts by the tokenizers library alone."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
