"""The training-data operators against brute force, round trips and edge cases."""

import collections
import datetime
import hashlib
import re
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.llm import audio, bpe, chat, common, langid, packing, quality, queries, simhash, substrings, tokenstore, urlfilter
from kinlink.llm.common import materialised, quiet_tokenizer

LONG = "lorem ipsum dolor sit amet " * 4000
ODD = ["", None, " ", "\n\n", "a  b", "x\ty z", "it's 12 345.", "<|endoftext|>", "é" * 300, "İstanbul ΣΣ", "a\x1cb\x85c", "日本語 テキスト", "éa .́"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def table(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


# 1


def test_url_oracle(spark, duck, data):
    mine = queries.op1_url_filter(spark, data).toPandas().sort_values("page_id").astype(str)
    theirs = duck.sql(urlfilter.ORACLE).df().sort_values("page_id").astype(str)
    assert mine[sorted(mine)].replace("nan", "None").values.tolist() == theirs[sorted(theirs)].replace("nan", "None").values.tolist()


def test_url_intervals(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    entries = [("l", "domain", "Example.com", "add", day(2)), ("l", "domain", "example.com", "remove", day(5)), ("l", "domain", "example.com", "add", day(5)), ("m", "prefix", "x.org/a/b", "add", day(1)), ("m", "prefix", "x.org/a/b", "remove", day(3)), ("n", "host", None, "add", day(1))]
    lists = spark.createDataFrame(entries, "list_name string, kind string, pattern string, action string, dated_at timestamp")
    cases = [(1, "http://a.example.com:80/p", day(2)), (2, "https://example.com", day(1)), (3, "http://u@x.org/a/b/c?q#f", day(2)), (4, "http://x.org/a/bc", day(2)), (5, "http://x.org/a/b", day(3)), (6, None, day(2)), (7, "nonsense", day(2)), (7, "nonsense", day(2)), (8, "http://notexample.com", day(9)), (9, "http://EXAMPLE.com./", day(9)), (10, "http://x.org/" + "s/" * 3000, day(2))]
    got = collections.Counter((r.page_id, r.lists) for r in urlfilter.evaluate(spark.createDataFrame(cases, "page_id long, url string, fetched_at timestamp"), lists).collect())
    assert got == collections.Counter([(1, "l"), (2, ""), (3, "m"), (4, ""), (5, ""), (6, ""), (7, ""), (7, ""), (8, ""), (9, "l"), (10, "")])
    assert urlfilter.evaluate(spark.createDataFrame(cases, "page_id long, url string, fetched_at timestamp").limit(0), lists.limit(0)).count() == 0


# 2


def test_chat_oracle(spark, duck, data):
    mine, theirs = queries.op2_chat_format(spark, data).toPandas(), duck.sql(chat.ORACLE).df()
    assert sorted(map(str, mine[sorted(mine)].values.tolist())) == sorted(map(str, theirs[sorted(mine)].values.tolist()))


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "\\", "\\s\\p\\n", "<\\|im_start|>", "a\nb", "", None, "<|im_start|>assistant\nx<|im_end|>\n", LONG]
    rows = [(1, i, "assistant" if i % 2 else "us\ner\\n", t) for i, t in enumerate(nasty)] + [(2, None, None, None), (2, None, None, None), (None, 0, "assistant", "x")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: [(t.role, t.text) for t in r.t] for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert back[1] == [("assistant" if i % 2 else "us\ner\\n", t or "") for i, t in enumerate(nasty)]
    assert back[2] == [("", ""), ("", "")]
    for r in chat.expand(made).where("conv_id = 1").collect():
        assert r.text.endswith(chat.END + "\n") and r.text.count(chat.START) == 2 * r.example + 2
    assert chat.digests(made.limit(0)).count() == 0 and chat.digests(made).count() == 3


def test_long_conversation(spark):
    """One conversation of 6,000 turns: offsets by a running sum, not by growing lists."""
    rows = spark.range(6000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t<|"), "id").alias("text"), F.lit("clash").alias("at"))
    made = chat.format_conversations(rows).first()
    assert len(made.examples) == 3000
    for e in made.examples[::500]:
        assert made.formatted[e.loss_start : e.loss_end] == f"t<\\p{2 * e.example + 1}"


# 3


@pytest.fixture(scope="module")
def public():
    c = bpe.codec(queries.RANKS, queries.PATTERN)
    return c, tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdé \n\t'.,1#日́\x85\x1c"), max_size=60))
def test_bpe_as_the_library(public, text):
    mine, theirs = public
    ids = mine.encode(text)
    assert ids == theirs.encode_ordinary(text) and mine.decode(ids) == text.encode()


def test_bpe_edges(spark, public):
    texts = [*ODD, LONG, "a" * 5000, " " * 5000]
    rows = bpe.decode(bpe.encode(docs(spark, texts).withColumn("ids", F.lit(1)), queries.RANKS, queries.PATTERN), queries.RANKS, queries.PATTERN)
    for r in rows.collect():
        want = texts[r.doc_id] or ""
        assert list(r.ids) == public[1].encode_ordinary(want) and bytes(r.decoded) == want.encode()
    assert bpe.digests(rows.limit(0)).count() == 0


# 4


def brute_counts(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = collections.Counter(tri)
    pos = {p for k, x in enumerate(tri) if n[x] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(pos)


def test_quality_counts(spark, data):
    texts = [*ODD, LONG, "a a a a a", "a b c a b c d", "x\n\nx\n y\n y\nx"] + [r.text for r in table(spark, data, "documents").select("text").collect()]
    for r in quality.with_counts(docs(spark, texts)).collect():
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def brute_vector(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    n, chars = len(w), sum(map(len, w))
    marks, capitals = (len(re.findall(x, t or "")) for x in (r"[!-/0-9:-@\[-`{-~]", "[A-Z]"))
    raw = [np.log1p(n), np.log(chars / n), np.log((marks + 1) / (chars + 1)), np.log((capitals + 1) / (chars + 1)), np.log(len(set(w)) / n)]
    return np.floor(np.array(raw) * quality.SCALE + 0.5)


def inverse_factor(cov):
    low = np.zeros_like(cov)
    for i in range(len(cov)):
        for j in range(i + 1):
            left = cov[i, j] - low[i, :j] @ low[j, :j]
            low[i, j] = np.sqrt(max(left, quality.RIDGE * cov[i, i], quality.ROUNDING)) if i == j else left / low[j, j]
    return np.linalg.inv(low)


def brute_distances(x, groups):
    """The distance of every row of scaled integers, with numpy; groups: (lang, source) of each."""
    y, k = x / quality.SCALE, quality.PRIOR
    keys = [[(), (g[0],), g] for g in groups]
    every = sorted({q for row in keys for q in row}, key=len)
    at = {g: np.array([i for i, row in enumerate(keys) if g in row]) for g in every}

    def squared(par, rows):
        return (((y[rows] - par[0]) @ par[1].T) ** 2).sum(1)

    def bins(par, rows):
        return np.floor(np.log(squared(par, rows) + 1e-9) * quality.BINS_PER_E)

    params, base = {}, None
    for g in every:
        z = y[at[g]]
        q = np.quantile(z, (0.25, 0.5, 0.75), axis=0)
        width = np.sqrt(np.maximum(((q[2] - q[0]) / 1.349) ** 2, quality.ROUNDING))
        base = (q[1], np.diag(width**2) + np.outer(q[1], q[1])) if g == () else base
        pressed = np.cov(np.tanh((z - q[1]) / width).T, bias=True)
        sd = np.sqrt(np.maximum(np.diag(pressed), quality.ROUNDING))
        params[g] = [(q[1], inverse_factor(np.diag(width**2))), (z.mean(0), inverse_factor(np.cov(z.T, bias=True))), (q[1], inverse_factor(pressed / np.outer(sd, sd) * np.outer(width, width)))]
    for _ in range(quality.STEPS):
        mean = {}
        for g in every:
            for s, par in enumerate(params[g]):
                b = bins(par, at[g])
                cut = next(c for c in np.unique(b) if (b <= c).sum() >= np.ceil(len(b) * quality.SUBSET))
                inner = y[at[g][b <= cut]]
                m, c = inner.sum(0), inner.T @ inner
                up, n = mean[g[:-1], s] if g else base, len(inner) + k
                mean[g, s] = (m + k * up[0]) / n, (c + k * up[1]) / n
        params = {g: [(mean[g, s][0], inverse_factor(mean[g, s][1] - np.outer(mean[g, s][0], mean[g, s][0]))) for s in range(3)] for g in every}
    best = {g: min(enumerate(params[g]), key=lambda p: (round(-2 * np.log(np.diag(p[1][1])).sum(), 9), quality.STARTS[p[0]]))[1] for g in every}
    away = {}
    for g in every:
        b = bins(best[g], at[g])
        half = next(c for c in np.unique(b) if (b <= c).sum() >= len(b) / 2)
        mine = np.log(quality.CHI_MEDIAN) - (half + 0.5) / quality.BINS_PER_E
        away[g] = (len(b) * mine + k * away[g[:-1]]) / (len(b) + k) if g else mine
    return np.array([squared(best[g], [i])[0] * min(1, np.exp(away[g])) for i, g in enumerate(groups)])


def test_quality_estimate(spark, data):
    """Several languages and sources, small and large, against numpy."""
    rows = table(spark, data, "documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 7 < 4, "a").when(F.col("doc_id") % 7 < 6, "b").otherwise(F.lit(None)).alias("source"))
    texts = {r.doc_id: r for r in rows.collect()}
    got = quality.documents_quality(rows).toPandas()
    fit = got[~got.base_failed]
    want = brute_distances(np.array([brute_vector(texts[i].text) for i in fit.doc_id]), [(texts[i].lang or "", texts[i].source or "") for i in fit.doc_id])
    assert len(fit) >= 100 and np.allclose(fit.distance, want, rtol=1e-6, atol=1e-9)
    assert (got.kept == (~got.base_failed & (got.distance <= quality.CUTOFF))).all()


def test_quality_rejects_what_is_labelled_poor(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.documents_quality(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where("NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() >= 0.95 and got[got.quality == 0].kept.mean() <= 0.1


def test_quality_edges(spark):
    prose = [" ".join(f"word{(7 * k + j) % 90}" for j in range(60 + k)) + "." for k in range(5)]
    few = docs(spark, [*ODD, *prose, prose[0]]).withColumns({k: F.lit("clash") for k in ("kept", "grp", "scale", "par", "x0", "my col", "start")})
    counted = materialised(quality.with_counts(few), "few")
    got = quality.assess(counted).toPandas()
    assert list(got.columns) == [c for c in counted.columns if c != "kept"] + ["distance", "kept"]
    few_kinds = [" ".join(f"{'Aa'[j % 9 > k]}{'bcdefgh'[: 2 + (j * k) % 5]}{'.' if j % (7 + k) == 0 else ''}" for j in range(60 + 40 * k)) for k in range(5)]
    assert quality.documents_quality(docs(spark, few_kinds)).where("NOT base_failed AND NOT kept").count() == 0
    assert (got["grp"] == "clash").all() and (got["x0"] == "clash").all() and (got.kept == ~got.base_failed).all()
    none = quality.documents_quality(docs(spark, ODD)).toPandas()
    assert none.distance.isna().all() and not none.kept.any()
    assert quality.documents_quality(few.limit(0)).count() == 0


# 5


def brute_fingerprint(t, k=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if s and 2 * sum(x >> b & 1 for x in h) > len(s))


def brute_components(fps, most):
    name = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = name[a], name[b]
                name = [min(x, y) if n in (x, y) else n for n in name]
    return name


def close_fingerprints(seed, bases, copies, bits):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, bases, dtype=np.uint64)
    return np.unique(np.concatenate([base] + [base ^ np.array([sum({1 << int(b) for b in r.integers(0, 64, bits)}) for _ in range(bases)], np.uint64) for _ in range(copies)]))


def grouped(fps, edges, most):
    """Components by the edges, as ``brute_components`` names them."""
    name, at = list(range(len(fps))), {int(x): k for k, x in enumerate(fps)}
    for a, b in edges:
        assert (int(a) ^ int(b)).bit_count() <= most
        x, y = name[at[int(a)]], name[at[int(b)]]
        name = [min(x, y) if n in (x, y) else n for n in name]
    return name


@pytest.mark.parametrize("most", [0, 3, 8])
def test_gray_forest(most):
    fps = close_fingerprints(most, 12, 25, 3)
    assert grouped(fps, simhash.forest(fps, most), most) == brute_components(fps.tolist(), most)
    half = len(fps) // 2
    one, two = fps[::2], fps[1::2]
    edges = np.concatenate([simhash.forest(one, most), simhash.forest(two, most), simhash.forest(one, most, two)])
    assert half and grouped(fps, edges, most) == brute_components(fps.tolist(), most)


def test_gray_search_prunes_masked_groups():
    fps = np.sort(close_fingerprints(1, 200, 5, 2))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    cuts = np.arange(0, len(fps), 16)
    pattern, mask = simhash.shared_bits(fps, np.full(len(fps), simhash.FULL), cuts)
    found = set()
    for q, leaf in simhash.GrayIndex(pattern, mask).search(pattern, mask, np.zeros(len(cuts), np.int64), 1):
        found |= set(zip(q.tolist(), leaf.tolist()))
    near = {(a // 16, b // 16) for a in range(len(fps)) for b in range(len(fps)) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 1}
    assert near <= found and len(found) < len(cuts) ** 2 / 2


@pytest.mark.parametrize("group,finish", [(1 << 16, 10**6), (16, 3)])
def test_links_and_components(spark, group, finish):
    fps = close_fingerprints(5, 10, 8, 2)
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    ranks = [r.k for r in rows.select("fp", simhash.rank_column(F.col("fp")).alias("k")).orderBy("fp").collect()]
    assert [k + 2**63 for k in ranks] == simhash.gray_rank(np.sort(fps.view(np.int64)).view(np.uint64)).tolist()
    got = {x.node: x.root for x in simhash.components(simhash.links(rows, 3, group), finish).collect()}
    signed, name = fps.view(np.int64).tolist(), brute_components(fps.tolist(), 3)
    groups, mine = collections.defaultdict(set), collections.defaultdict(set)
    for x, n in zip(signed, name):
        groups[n].add(x)
        mine[got.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_index_serves_all_links(spark):
    """On sf0.01, with near copies of a tenth of its fingerprints, every link
    comes out of the index, as comparing all pairs finds them."""
    fps = simhash.fingerprints(table(spark, "/root/testdata/sf0.01", "documents")).select("fp").distinct()
    near = fps.where(F.pmod("fp", F.lit(10)) == 0).select(F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(x)) for x in (1 << 40, 7 << 20, -(1 << 63) | 5)))).alias("fp"))
    fps = materialised(fps.unionByName(near).distinct(), "fps")
    every = np.array([r.fp for r in fps.collect()], np.int64).view(np.uint64)
    edges = np.array([tuple(r) for r in simhash.links(fps).collect()], np.int64).reshape(-1, 2).view(np.uint64)
    assert grouped(every, edges, 3) == brute_components(every.tolist(), 3) and len(edges)


def test_simhash_query(spark, data):
    rows = table(spark, data, "documents").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)] + [(10**6 + 50, LONG)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(rows).collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    assert [got[i][0] for i in ids] == fps
    assert [got[i][1] for i in ids] == [ids[k] for k in brute_components(fps, 3)]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


# 6


def tone(*hz, rate=8000):
    return np.concatenate([9000 * np.sin(2 * np.pi * h * np.arange(rate // 5) / rate) for h in hz])


def test_audio_alignment(spark):
    r = np.random.default_rng(1)
    notes = 220 * 2 ** (r.integers(0, 24, 60) / 12)
    whole = audio.codes(audio.chroma(tone(*notes)))
    shifted = audio.codes(audio.chroma(tone(*notes)[audio.HOP * 12 :]))
    noisy = audio.codes(audio.chroma(tone(*notes) + r.normal(0, 200, 60 * 1600)))
    other = audio.codes(audio.chroma(tone(*(220 * 2 ** (r.integers(0, 24, 60) / 12)))))
    search = audio.Searcher([(0, whole)])
    assert search.best(7, shifted)[:2] == (0, 12) and search.best(7, shifted)[2] < 0.01
    assert search.best(8, noisy)[:2] == (0, 0)
    assert search.best(9, other) is None and search.best(0, whole) is None


def test_audio_edges(spark, data):
    rows = spark.createDataFrame([(0, None), (1, b"junk"), (None, b""), (100, audio.synthesise([0.1, -0.5, 0.9, 0.3] * 16, 0)), (5, audio.synthesise([0.1, -0.5, 0.9, 0.3] * 16, 0))], "vec_id long, audio binary")
    got = {r.vec_id: r for r in audio.search(audio.fingerprints(rows)).collect()}
    assert got[0].n_codes == got[1].n_codes == 0 and got[5].match_id == 100 and got[5].match_errors == 0.0
    assert audio.search(audio.fingerprints(rows.limit(0))).count() == 0
    assert queries.op6_audio(spark, data).count() == table(spark, data, "embeddings").count()


# 7


def brute_cut(rows, n=50):
    least = {}
    for i, b in rows:
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if least[b[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_prefix_classes():
    r = np.random.default_rng(3)
    parts = [bytes(r.integers(97, 100, int(k))) for k in r.integers(3, 40, 30)] + [b"abcabcabcabcabcabc", b"a" * 30, b"a" * 31]
    docs_ = r.integers(0, 9, len(parts))
    got = substrings.least_documents(parts, docs_, 5)
    for p, g in zip(parts, got):
        want = [min(int(d) for q, d in zip(parts, docs_) if p[k : k + 5] in q) for k in range(len(p) - 4)]
        assert g.tolist() == want


def test_substrings(spark, data):
    shared = "".join(chr(97 + int(x)) for x in np.random.default_rng(2).integers(0, 26, 400))
    made = [shared[:49], shared[:50], "é" * 60, "zé" + "é" * 70, shared, "pre" + shared[10:200] + "post" + shared[150:320], LONG, LONG, "q" * 3000, "q" * 120, None, "", shared]
    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").select("doc_id", "text").collect()] + [(10**6 + i, t) for i, t in enumerate(made)] + [(10**6 + 4, shared + "tail")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = sorted(tuple(r) for r in substrings.digests(substrings.dedup(frame)).collect())
    assert got == brute_cut([(i, (t or "").encode()) for i, t in rows])
    assert substrings.dedup(frame.limit(0)).count() == 0
    for r in substrings.dedup(frame, whole_characters=True).collect():
        bytes(r.kept).decode()


# 8 and 9


def slow_first_fit(lengths, capacity):
    free, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(capacity)
        out[i] = (b, capacity - free[b])
        free[b] -= lengths[i]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 64)
    assert list(zip(bins.tolist(), offsets.tolist())) == slow_first_fit(lengths, 64)


def test_packing(spark):
    texts = [*ODD, LONG, "same", "same"]
    frame = docs(spark, texts)
    tok = quiet_tokenizer(queries.PIECES)
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    got = packing.checked(packing.pack(frame, queries.PIECES, queries.PATTERN, group_tokens=40)).collect()
    at = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    assert max(at.values()) <= 1024 and sum(at.values()) == sum(map(len, want.values()))
    assert packing.pack(frame.limit(0), queries.PIECES, queries.PATTERN).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700))
def test_addressable(ids):
    store = tokenstore.DirectlyAddressable(tokenstore.DirectlyAddressable.pack(np.array(ids, np.uint32)))
    assert [store[i] for i in range(0, len(ids), 7)] == ids[::7]
    for a, b in [(0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))]:
        assert store.slice(a, b).tolist() == ids[a:b]
    data = tokenstore.DirectlyAddressable.pack(np.array(ids, np.uint32))
    assert [tokenstore.token_in(lambda a, n: data[a : a + n], i) for i in range(0, len(ids), 7)] == ids[::7]


def test_one_token_reads_little(spark, data, tmp_path, monkeypatch):
    """A token takes a few hundred bytes of its shard, the file's footer aside."""
    path, read = f"file://{tmp_path}/store", []
    tokenstore.write_store(table(spark, data, "documents"), queries.WORDS, 2, path)
    shards = spark.read.parquet(path)
    assert shards.count() > 2 and shards.agg(F.min(F.octet_length("data"))).first()[0] > 20_000
    token_in = tokenstore.token_in
    monkeypatch.setattr(tokenstore, "token_in", lambda f, i: token_in(lambda a, n: read.append(n) or f(a, n), i))
    some = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in tokenstore.read_documents(spark, path).where("doc_id % 50 = 3").collect()}
    for d, ids in some.items():
        read.clear()
        assert tokenstore.token_at(spark, path, d, len(ids) // 2) == ids[len(ids) // 2] and sum(read) < 1000


def test_token_store(spark, tmp_path):
    texts = [*ODD, LONG, "The the THE."]
    tok, start = quiet_tokenizer(queries.WORDS), 0
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(docs(spark, texts), queries.WORDS, 2, path)
    for r in tokenstore.read_documents(spark, path).orderBy("doc_id").collect():
        want = [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.start == start and r.n_tokens == len(want)
        start += len(want)
    for d, i in [(0, 0), (len(ODD), 0), (len(ODD), 4567), (len(ODD) + 1, 3)]:
        assert tokenstore.token_at(spark, path, d, i) == [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 2][i]
    with pytest.raises(IndexError):
        tokenstore.token_at(spark, path, 0, 1)
    tokenstore.write_store(docs(spark, texts).limit(0), queries.WORDS, 2, path + "0")
    assert tokenstore.read_documents(spark, path + "0").count() == 0


# 10


def test_language(spark, data):
    got = queries.op10_langid(spark, data).join(table(spark, data, "documents").select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = got[got.held_out & (got.text.str.len() > 200)]
    assert (held.lang_pred == held.lang).mean() >= 0.9 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()


def brute_language(text, model):
    """Language and score by compressing every chunk with each dictionary."""
    if not text or not re.search(r"[^\W\d_]", text) or not model:
        return "und", 0.0
    data, sizes = text.encode(), []
    for lang, content in sorted(model.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append((sum(len(c.compress(data[a : a + langid.CHUNK_BYTES])) for a in range(0, len(data), langid.CHUNK_BYTES)), lang))
    sizes.sort()
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]


def test_language_against_brute_force(spark, data):
    rows = table(spark, data, "documents")
    texts = {r.doc_id: r for r in rows.collect()}
    model = langid.learn(rows.where(~langid.held_out(F.col("doc_id"))))
    learned = collections.defaultdict(list)
    for r in rows.withColumn("h", F.xxhash64("doc_id")).collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and re.search(r"[^\W\d_]", r.text or ""):
            learned[r.lang].append((len(r.text.encode()) > langid.SAMPLE_BYTES, r.h, r.doc_id, r.text))
    assert model == {k: "\n".join(x[3] for x in sorted(v)[: langid.SAMPLE_DOCS][::-1]).encode() for k, v in learned.items()}
    for r in queries.op10_langid(spark, data).collect():
        assert (r.lang_pred, round(r.score, 12)) == (lambda x: (x[0], round(x[1], 12)))(brute_language(texts[r.doc_id].text, model))


def test_language_edges(spark):
    frame = docs(spark, [*ODD, LONG]).withColumn("score", F.lit("clash"))
    model = langid.learn(frame.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy")))
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[1].rejected
    assert langid.predict(frame.limit(0), model).count() == 0
    assert langid.predict(frame, {}).where("lang_pred <> 'und'").count() == 0


def test_written_tables_leave_no_garbage(spark, monkeypatch):
    """A heap above its share is collected when a table is written, not when it has grown to its limit."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collections = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    before = collections()
    assert common.materialised(spark.range(3), "few").count() == 3 and collections() > before
