"""The pipeline against plain Python over a small table."""

import collections
import hashlib
import math

import numpy as np
import public_tokenizers

import corpus_pipeline
from chronoweave.llm import bpe, line_dedup, mixing, quality_cnn, setsketch

SF = "/root/testdata/sf0.001"


def mixture(docs):
    """{doc_id: copies} by sorting each source as a whole."""
    size = {i: len(t.encode().split()) for i, t, _ in docs}
    sources = sorted({s for *_, s in docs if s is not None}) + ([None] if any(s is None for *_, s in docs) else [])
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    while free:
        left, w = mixing.SHARE * sum(total.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} if over else {s: left * weight[s] / w for s in free}
        free = free - over if over else set()
    copies = {}
    for s in sources:
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        budget, before, keyed = target[s] - epochs * total[s], 0, []
        for i, t, x in docs:
            if x == s:
                u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                keyed.append((-math.log(u) / (1.0 if size[i] and 3 * size[i] <= len(t) <= 12 * size[i] else 0.5), i))
        for _, i in sorted(keyed):
            copies[i] = epochs + (before + size[i] / 2 <= budget)
            before += size[i]
    return copies


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_cnn.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.orderBy("doc_id").collect()]
    rows = [r for r in rows if quality_cnn.score(model, r[1].encode()) >= 0.3]
    seen, kept = [], []
    for i, t, s in rows:
        lines, gone = [], 0
        for line in t.split("\n"):
            w = [x for x in line.replace("\t", " ").replace("\r", " ").split(" ") if x]
            if len(w) >= line_dedup.MIN_WORDS:
                own = set(w)
                again = any(4 * len(own & o) >= 3 * len(own | o) for o in seen)
                seen.append(own)
                if again:
                    gone += 1
                    continue
            lines.append(line)
        if not gone or "\n".join(lines):
            kept.append((i, "\n".join(lines), s))
    sets = {i: set(setsketch.shingles(t).tolist()) for i, t, _ in kept}
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    kept = [r for r in kept if find(r[0]) == r[0]]
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = collections.Counter()
    copies = mixture(kept)
    for i, t, _ in kept:
        code = enc.encode_ordinary(t)
        want[i, len(code), hashlib.sha256(np.array(code, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += copies[i]
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and len(got) > 100


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
