"""Plain versions that several tests compare with."""

import re


def norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]
