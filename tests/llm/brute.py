"""Plain versions to hold the operators against."""

from collections import Counter


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def shingles(text, k):
    w = words(lower_az(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs, k, num, den):
    """docs: (doc_id, text). (doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num:
                shared = len(x & y)
                if den * shared >= num * (len(x) + len(y) - shared):
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    return sorted((d, len(s), root(d)) for d, s in sets)


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
