import numpy as np

from citeflow.llm import prefix_forest


def rows_read(forest, q):
    """(distinct rows that each query reads, its depth), by comparing all strings digit by digit, without the trees' searches."""
    x = [[bytes(v).ljust(forest.depth, b"\0") for v in prefix_forest.strings(forest.near, r)] for r in forest.rotations]
    own = [[bytes(v).ljust(forest.depth, b"\0") for v in prefix_forest.strings(q, r)] for r in forest.rotations]
    out = []
    for i in range(len(q)):
        for level in range(forest.depth, -1, -1):
            hits = [[j for j, s in enumerate(rows) if s[:level] == mine[i][:level]] for rows, mine in zip(x, own)]
            if level == 0 or sum(map(len, hits)) >= forest.candidates:
                out.append((len(set().union(*hits)), level))
                break
    return np.array(out)


def test_strings_are_long_and_sorted_runs_share_prefixes():
    r = np.random.default_rng(3)
    for dim in (3, 40, 200):
        x = np.repeat(r.normal(size=(30, dim)), 4, axis=0) + 0.01 * r.normal(size=(120, dim))
        forest = prefix_forest.Forest(np.arange(120), x, trees=3, candidates=5)
        assert forest.depth == min(16, dim)
        tree, own = forest.trees[0], prefix_forest.strings(x.astype(np.float32), forest.rotations[0])
        assert (tree.descend(own) == forest.depth).all()
        digits = tree.digits(tree.strings)
        for length in range(1, forest.depth + 1):
            lo, hi = tree.run(own, length)
            for i in range(0, 120, 7):
                same = (digits[:, :length] == tree.digits(own[i : i + 1])[:, :length]).all(1)
                assert same.sum() == hi[i] - lo[i] and same[lo[i] : hi[i]].all()


def test_approximate_search_reads_a_share_and_finds_the_nearest():
    r = np.random.default_rng(8)
    centres = r.normal(size=(60, 16))
    near = centres[r.integers(0, 60, 3000)] + 0.15 * r.normal(size=(3000, 16))
    x = np.concatenate([near, r.normal(size=(1000, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = prefix_forest.Forest(np.arange(len(x)), x, trees=24, candidates=200)
    asked = np.arange(0, len(x), 40)
    q32 = x[asked].astype(np.float32)
    read, depth = rows_read(forest, q32).T
    lo, hi, level = forest.matches(q32)
    assert level.tolist() == depth.tolist() and len(set(level.tolist())) > 2
    assert [len(np.unique(np.concatenate([t.rows[a:b] for t, a, b in zip(forest.trees, lo[:, i], hi[:, i])]))) for i in range(len(asked))] == read.tolist()
    share = read.mean() / len(x)
    ids, found, _ = forest.search(asked, x[asked], 20)
    got = set(zip(ids.tolist(), found.tolist()))
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = {(int(q), int(j)) for q, s in zip(asked, score) for j in np.argsort(-s)[:20]}
    recall = len(got & want) / len(want)
    print("share", share, "recall", recall)
    print("rows by depth", {int(d): int((depth == d).sum()) for d in np.unique(depth)})
    assert 0 < share < 0.2 and recall >= 0.9
