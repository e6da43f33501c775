"""Plain versions that the operators are held against."""


def linked_by_words(rows, width, threshold):
    """The smallest id that each id is linked with, comparing sets of word tuples all with all."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = sorted(i for i in sets if sets[i])
    for k, i in enumerate(by):
        for j in by[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 100 >= threshold * max(len(a), len(b)) and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets}, {i: len(x) for i, x in sets.items()}
