import math
import random

import xxhash
from docloom.plans.catalogue import QUERIES


def slow_vector(text, dimension=32):
    counts = [0.0] * dimension
    for w in text.lower().split():
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        signed = h - (1 << 64) if h >> 63 else h
        counts[signed % dimension] += 1.0 if h >> 40 & 1 else -1.0
    norm = math.sqrt(sum(x * x for x in counts))
    return [x / max(norm, 1e-8) for x in counts]


def test_hashing_vectors_read_the_whole_text(spark, tmp_path):
    rng = random.Random(1)
    start = "the same words " * 30
    texts = [start + " ".join(rng.choice("abcdefghijk") + str(rng.randrange(50)) for _ in range(400)) for _ in range(3)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = {r.doc_id: r.embedding for r in QUERIES["hashing_vectors"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert all(abs(a - b) < 1e-5 for a, b in zip(got[i], slow_vector(t), strict=True))
