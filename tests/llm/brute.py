"""Plain versions of the operators for small inputs."""

import re

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, k=5):
    words = WORD.findall(lower(text))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_components(rows, percent=75):
    """{doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in sorted(sets.items()):
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def pieces(text):
    """(number, begin, end) in bytes of the paragraphs that a text is cut into."""
    import pyarrow as pa

    from curatrix.llm import paragraphs
    from curatrix.llm.words import text_arrays
    data, offsets = text_arrays(pa.array([text or ""]))
    _, number, begin, end, _ = paragraphs._paragraphs(data, *paragraphs._words(data, offsets))
    return list(zip(number.tolist(), begin.tolist(), end.tolist()))


def repeated_pieces(docs):
    """{(doc, number)} of the paragraphs that are not the first of their component, by all pairs."""
    units = [((i, n), (t or "").encode()[a:b].decode()) for i, t in docs for n, a, b in pieces(t)]
    return {k for k, (_, first) in near_components(units).items() if first != k}


def template(text):
    """(template token, word) of every word of a text, by the rules in plain words."""
    from curatrix.llm.decontaminate import UNITS
    out = []
    for raw in WORD.findall(text or ""):
        plain = [i for i, c in enumerate(raw) if c.isascii() and c.isalnum() or ord(c) >= 128]
        if not plain:
            continue
        word = raw[plain[0]:plain[-1] + 1]
        small = len(word) > 1 and ("a" <= word[1] <= "z" or ord(word[1]) >= 128)
        if all(c in "0123456789$%+,-./:" for c in word) and any(c.isdigit() for c in word):
            token = "<number>"
        elif lower(word) in UNITS:
            token = "<unit>"
        elif small and ("A" <= word[0] <= "Z" or "À" <= word[0] <= "Þ"):
            token = "<name>"
        else:
            token = lower(word)
        out.append((token, lower(word)))
    return out


def leaks(docs, items, coverage=0.5):
    """{(doc, item): (covered, exact)} over all windows and all alignments."""
    from curatrix.llm.decontaminate import _word_hash

    def order(w):
        return int(_word_hash([w]).view("int64")[0])

    slot = {"<number>", "<unit>", "<name>"}
    out = {}
    for d, doc in docs:
        have = template(doc)
        for i, item in items:
            want = template(item)
            if not want:
                continue
            if len(want) < 4:
                if [w for _, w in want] == [w for _, w in have]:
                    out[d, i] = max(out.get((d, i), (0, False)), (1.0, True))
                continue
            size = min(8, len(want))
            asked = [(p, want[p:p + size]) for p in range(len(want) - size + 1)]
            if size == 8:
                some = [(p, w) for p, w in asked if sum(t not in slot for t, _ in w) >= 2]
                asked = some or asked
            votes, same = set(), []
            for shift in range(-len(want), len(have)):
                met = [(p, {(a, b) for (t, a), (_, b) in zip(w, have[p + shift:p + shift + size]) if t in slot}) for p, w in asked
                       if 0 <= p + shift <= len(have) - size and [t for t, _ in w] == [t for t, _ in have[p + shift:p + shift + size]]]
                pairs = [x for _, held in met for x in held]
                best = {a: max(((pairs.count((a, b)), a == b, order(b)), b) for x, b in set(pairs) if x == a)[1] for a, _ in set(pairs)}
                voting = {p for p, held in met if all(best[a] == b for a, b in held)}
                if voting:
                    votes |= voting
                    same.append(all(a == b for a, b in pairs))
            if votes and len(votes) / len(asked) >= coverage:
                old = out.get((d, i), (0, False))
                out[d, i] = (max(old[0], len(votes) / len(asked)), max(old[1], all(same)))
    return out
