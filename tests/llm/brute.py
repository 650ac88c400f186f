"""Plain versions of the operators' rules, for comparison."""

import hashlib
import re

import xxhash


def units(text):
    return [u for u in re.findall(r"(?s).*?(?:\n|[.!?] |。|\Z)", text) if u]


def chunks(us):
    """(start, size) of each chunk of two units or more."""
    h = [int(hashlib.md5(u.encode()).hexdigest()[0], 16) for u in us]
    ends = [*[i for i in range(1, len(us) - 1) if (5 * h[i - 1] + h[i]) % 16 < 12], len(us) - 1]
    starts = [0, *[e - 1 for e in ends[:-1]]]
    return [(a, e - a + 1) for a, e in zip(starts, ends)] if len(us) > 1 else []


def thinned(texts):
    """{key: text without the chunks that occurred before}, in the order of the keys."""
    seen, left = set(), {}
    for key in sorted(texts):
        us, gone = units(texts[key]), set()
        for start, size in chunks(us):
            body = "".join(us[start : start + size])
            if len(body) >= 32:
                if body in seen:
                    gone.update(range(start, start + size))
                seen.add(body)
        kept = [i for i in range(len(us)) if i not in gone]
        out = ""
        for n, i in enumerate(kept):
            if n and kept[n - 1] < i - 1 and us[i - 1].endswith("\n") and not us[kept[n - 1]].endswith("\n"):
                out += "\n"
            out += us[i]
        left[key] = re.sub(r"[ \n]+\Z", "", out) if gone else texts[key]
    return left


def repeated_words(words):
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for where in at.values() if len(where) > 1 for i in where for k in range(5)})


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
