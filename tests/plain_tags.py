"""Tags of one labelled snippet in plain Python, which tests compare with."""

import regex

from lawmill.functions import patterns as P
from lawmill.operators.tagging import _LAW_WORDS


def substring_spans(text: str, forms: list[str]) -> list[tuple[int, int]]:
    """[JON-9] All places of the forms in text, whatever the case, overlapping ones too."""
    out, low = set(), text.lower()
    for form in dict.fromkeys(f for x in forms for f in (x.strip(), x.strip().rstrip(".,;: ")) if f):
        at = low.find(form.lower())
        while at >= 0:
            out.add((at, at + len(form)))
            at = low.find(form.lower(), at + 1)
    return sorted(out)


def law_range(tokens: list[str], first: int, last: int) -> tuple[int, int] | None:
    """[SEM-6, SRT-7] Of the four readings of a counted range, that with most law words, then the longest, then the first."""
    words = [*_LAW_WORDS, *P.SHORT_NAMES]
    best = None
    for a, b in ((first, last), (first - 1, last - 1), (first, last - 1), (first - 1, last)):
        if 0 <= a <= b < len(tokens):
            said = " ".join(tokens[a : b + 1]).lower()
            score = 2 * sum(w in said for w in words) + 0.01 * (b - a + 1)
            if best is None or score > best[0]:
                best = score, (a, b)
    return best[1] if best else None


def article_places(clean: list[str], article: str) -> list[list[int]]:
    """[JON-10] Tokens equal to article after "điều", or with it among the eight before."""
    out = []
    for i, c in enumerate(clean):
        if c == article and "điều" in clean[max(0, i - 8) : i]:
            out.append([i - 1, i] if clean[i - 1] == "điều" else [i])
    return out


_CLEAN = ".,;:()[]{}“”\"'`"
_TOKENS = regex.compile(P.TOKEN)


def tag(text: str, laws: list[tuple[str, str]], articles: list[str], fallback: tuple[int, int] | None) -> list[str]:
    """[SEM-5, SEM-7, SEM-8, SRT-8] BIO tags of a normalised text; laws: (normalised, as given).

    Laws first, each at its longest hit; the counted range only if none was found; articles overwrite them.
    """
    spots = [m.span() for m in _TOKENS.finditer(text)]
    words = [text[a:b] for a, b in spots]
    tags = ["O"] * len(words)

    def mark(at: list[int], label: str) -> None:
        for k, i in enumerate(sorted(set(at))):
            tags[i] = ("B-" if k == 0 else "I-") + label

    done = False
    for norm, given in laws:
        hits = substring_spans(text, [norm]) or substring_spans(text, [given, norm])
        if hits:
            a, b = max(hits, key=lambda s: s[1] - s[0])
            if at := [i for i, (s, e) in enumerate(spots) if e > a and s < b]:
                mark(at, "LAW")
                done = True
    if not done and fallback and (r := law_range(words, *fallback)):
        mark(list(range(r[0], r[1] + 1)), "LAW")
    clean, used = [w.strip(_CLEAN).lower() for w in words], set()
    for art in dict.fromkeys(a.strip() for a in articles if a and a.strip()):
        for at in article_places(clean, art.strip(_CLEAN).lower()):
            if tuple(at) not in used:
                used.add(tuple(at))
                mark(at, "ART")
                break
    return tags
