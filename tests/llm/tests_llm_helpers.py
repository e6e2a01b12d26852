"""Brute-force versions of pipeline stages."""

import re

from corpusmill.llm.words import WORD


def brute_lines(docs, need):
    """(doc_id, text) to (text left, whether a line is left), run by run."""
    words = lambda x: max(1, len(re.findall(r"[^ \t\n\x0b\f\r]+", x)))
    seen, gone, lines = set(), {}, {}
    for d, t in sorted(docs):
        own = lines[d, t] = t.split("\n")
        for s in range(len(own)):
            total = 0
            for e in range(s, len(own)):
                total += words(own[e])
                if total >= need:
                    run = hash(tuple(own[s : e + 1]))
                    if run in seen:
                        gone.setdefault((d, t), set()).update(range(s, e + 1))
                    seen.add(run)
    return {k: ("\n".join(x for i, x in enumerate(own) if i not in gone.get(k, ())), len(gone.get(k, ())) < len(own)) for k, own in lines.items()}


def brute_overlaps(docs, items, least=13, similarity=0.8):
    found = set()
    for i, u in items:
        b = WORD.findall(u.lower())
        need = min(least, len(b))
        places = {}
        for j, w in enumerate(b):
            places.setdefault(w, []).append(j)
        for d, t in docs:
            a = WORD.findall(t.lower())
            diagonals = {k - j for k, w in enumerate(a) for j in places.get(w, ())}
            for diagonal in diagonals:
                low, high = max(0, -diagonal), min(len(b), len(a) - diagonal)
                same = [a[diagonal + j] == b[j] for j in range(low, high)]
                if any(sum(same[k : k + need]) >= similarity * need - 1e-9 for k in range(len(same) - need + 1)):
                    found.add((d, i))
                    break
    return found
