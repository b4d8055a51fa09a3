"""Every match of a recording, against trying all queries and offsets."""

import collections

import numpy as np

from kinlink.llm import audio, queries


def brute(id_, mine, queries):
    """Of each query the fullest offset that passes."""
    out, shift = [], np.uint32(32 - audio.ALIGN_BITS)
    for q, theirs in queries:
        places = collections.defaultdict(list)
        for i, x in enumerate((theirs >> shift).tolist()):
            places[x].append(i)
        votes = collections.Counter(i - j for j, y in enumerate((mine >> shift).tolist()) for i in places[y])
        for o, n in sorted(votes.items(), key=lambda v: (-v[1], v[0])) if q != id_ else ():
            pairs = [(theirs[j + o], mine[j]) for j in range(len(mine)) if 0 <= j + o < len(theirs)]
            errors = sum(int(x ^ y).bit_count() for x, y in pairs) / (32 * len(pairs))
            if n >= audio.MIN_VOTES and len(pairs) >= audio.MIN_OVERLAP and errors <= audio.MAX_ERRORS:
                out.append((errors, q, o))
                break
    return sorted(out)


def test_all_queries_of_a_group(spark):
    r = np.random.default_rng(4)
    kinds = [r.normal(size=64).tolist() for _ in range(3)]
    ids = [0, 1, 8, 100, 101, 200, 208, 300, 400, 400, 405, 500, None]
    rows = [(i, audio.synthesise(kinds[k % 3 if k > 8 else 0], (i or 0) % 8)) for k, i in enumerate(ids)]
    prints = [(i, audio.fingerprint(x)) for i, x in rows]
    queries = [(i, c) for i, c in prints if i is not None and i % audio.QUERY_EVERY == 0]
    got = audio.search(audio.fingerprints(spark.createDataFrame(rows, "vec_id long, audio binary")), block_bytes=1500).collect()  # several blocks
    mine = sorted((str(x.vec_id), [(m.errors, m.id, m.offset) for m in x.matches]) for x in got)
    assert mine == sorted((str(i), brute(i, c, queries)) for i, c in prints)
    assert {m.id for m in next(x for x in got if x.vec_id == 1).matches} >= {0, 100, 200, 300}
    for x in got:
        assert x.n_matches == len(x.matches) and (x.match_errors, x.match_id, x.match_offset) == (tuple(x.matches[0]) if x.matches else (None, None, None))


def test_next_offset_is_tried():
    r = np.random.default_rng(5)
    theirs = r.integers(0, 2**32, 60, dtype=np.uint32)
    mine = theirs ^ np.uint32(1 << 31)  # one bit off, so no votes
    mine[20:25] = theirs[20:25]  # five votes for offset 0
    mine[-10:] = theirs[:10]  # ten for -50, where the overlap is too short
    found = audio.Searcher([(0, theirs)]).matches(7, mine)
    assert found == brute(7, mine, [(0, theirs)]) and [m[1:] for m in found] == [(0, 0)]


def test_query_against_brute_force(spark, data):
    """The registered query over the whole table: each row against all queries."""
    prints = [(r.vec_id, np.frombuffer(r.codes, "<u4")) for r in audio.fingerprints(audio.recordings(spark.read.parquet(f"{data}/embeddings.parquet"))).collect()]
    asked = sorted((i, c) for i, c in prints if i % audio.QUERY_EVERY == 0)
    want = {i: brute(i, c, asked) for i, c in prints}
    got = queries.op6_audio(spark, data).collect()
    assert len(got) == len(prints) and any(want.values())
    assert {r.vec_id: [(m.errors, m.id, m.offset) for m in r.matches] for r in got} == want
