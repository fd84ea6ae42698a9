"""The published Spanish Snowball stemmer, for use on a distinct vocabulary."""

from __future__ import annotations

V = set("aeiouáéíóúü")
# Fixed values of the algorithm.
PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
GERUNDS = "iéndo ándo ár ér ír".split(), "iendo ando ar er ir".split()
STEP1 = [
    ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(), ""),
    ("adora ador ación adoras adores aciones ante antes ancia ancias".split(), "ic"),
    ("logía logías".split(), "log"), ("ución uciones".split(), "u"), ("encia encias".split(), "ente"),
]
Y_VERBS = "yeron yendo yamos yais yan yen yas yes ya ye yo yó".split()
EN_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _regions(w: str) -> tuple[int, int, int]:
    n = len(w)

    def after(i: int) -> int:
        while i < n and w[i] not in V:
            i += 1
        while i < n and w[i] in V:
            i += 1
        return min(i + 1, n)

    r1 = after(0)
    r2 = after(r1)
    if n < 3:
        return n, r1, r2
    if w[1] not in V:
        rv = next((i + 1 for i in range(2, n) if w[i] in V), n)
    elif w[0] in V:
        rv = next((i + 1 for i in range(2, n) if w[i] not in V), n)
    else:
        rv = 3
    return rv, r1, r2


def _longest(w: str, suffixes, start: int = 0) -> str:
    return max((s for s in suffixes if w.endswith(s) and len(w) - len(s) >= start), key=len, default="")


def _plain(w: str) -> str:
    return w.translate(str.maketrans("áéíóú", "aeiou"))


def stem(w: str) -> str:
    """The stem of one word in lower case."""
    rv, r1, r2 = _regions(w)
    pronoun = _longest(w, PRONOUNS, rv)
    if pronoun:
        head = w[: -len(pronoun)]
        accented, bare = _longest(head, GERUNDS[0], rv), _longest(head, GERUNDS[1], rv)
        if accented:
            w = head[: -len(accented)] + _plain(accented)
        elif bare or (head.endswith("uyendo") and len(head) - 5 >= rv):
            w = head
    before = w
    w = _step1(w, r1, r2)
    if w == before:
        suffix = _longest(w, Y_VERBS, rv)
        if suffix and w[: -len(suffix)].endswith("u"):
            w = w[: -len(suffix)]
        else:
            suffix = _longest(w, VERBS + EN_VERBS, rv)
            if suffix:
                w = w[: -len(suffix)]
                if suffix in EN_VERBS and w.endswith("gu"):
                    w = w[:-1]
    suffix = _longest(w, ["os", "a", "o", "á", "í", "ó", "e", "é"], rv)
    if suffix:
        w = w[: -len(suffix)]
        if suffix in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return _plain(w)


def _step1(w: str, r1: int, r2: int) -> str:
    every = [s for group, _ in STEP1 for s in group] + ["amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
    suffix = _longest(w, every)
    if not suffix:
        return w
    head = w[: -len(suffix)]

    def drop(head: str, *more: str) -> str:
        extra = _longest(head, more, r2)
        return head[: -len(extra)] if extra else head

    if suffix == "amente":
        if len(head) < r1:
            return w
        shorter = drop(head, "iv", "os", "ic", "ad")
        return drop(shorter, "at") if head.endswith("iv") and shorter != head else shorter
    if len(head) < r2:
        return w
    if suffix == "mente":
        return drop(head, "ante", "able", "ible")
    if suffix in ("idad", "idades"):
        return drop(head, "abil", "ic", "iv")
    if suffix in ("iva", "ivo", "ivas", "ivos"):
        return drop(head, "at")
    for group, more in STEP1:
        if suffix in group:
            return drop(head, more) if more == "ic" else head + more
    return w
