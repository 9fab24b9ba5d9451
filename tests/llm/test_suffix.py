import numpy as np

from wayfind.llm.suffix import longest_previous_factors


def test_longest_previous_factors_against_all_pairs():
    rng = np.random.RandomState(1)
    for trial in range(300):
        n, depth = rng.randint(1, 60), rng.randint(1, 20)
        data = rng.randint(97, 97 + rng.randint(1, 4), n + depth).astype(np.uint8)
        starts = np.sort(rng.choice(n, rng.randint(1, n + 1), replace=False))
        pos, first = rng.permutation(len(starts)), rng.randint(0, 3, len(starts)) if trial % 2 else None
        got = longest_previous_factors(data, starts, pos, depth, first)
        for i, s in enumerate(starts):
            best = 0
            for j, t in enumerate(starts):
                if pos[j] < pos[i] and (first is None or first[i] == first[j]):
                    size = 0
                    while size < depth and data[s + size] == data[t + size]:
                        size += 1
                    best = max(best, size)
            assert best == got[i]
