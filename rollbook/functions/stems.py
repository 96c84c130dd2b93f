"""French words without their endings, by tables of suffixes (the rules of the Snowball project's French stemmer, which are public).

A word has three regions: one behind its first vowels and two behind the first and second vowel that a consonant follows.
Which suffix goes, and what it leaves, depends on the region that it stands in.
"""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouyâàëéêèïîôöûü"
V, C = f"[{VOWELS}ù]", f"[^{VOWELS}ù]"
#: Words that say nothing by themselves.
STOP_WORDS = """au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous
on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant
suis es est sommes êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient
fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant eu eue eues eus ai as avons avez
ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie
aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent""".split()
#: Suffixes of nouns, adjectives and adverbs, by what is done with them.
DELETED = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
AGENTS = "atrice ateur ation atrices ateurs ations".split()
REPLACED = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
#: Endings of verbs in -ir, of others, and those before which an e goes as well.
VERBS_IR = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
VERBS_E = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()

_suffix = lambda words: re.compile("(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")$")
_NOUN = _suffix([*DELETED, *AGENTS, *REPLACED, "ement", "ements", "ité", "ités", "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments"])
_IR, _VERB = _suffix(VERBS_IR), _suffix([*VERBS, *VERBS_E, "ions"])
_DELETED, _AGENTS, _VERBS_E = map(frozenset, (DELETED, AGENTS, VERBS_E))


def _regions(word: str) -> tuple[int, int, int]:
    """Where the three regions begin: (rv, r1, r2)."""
    if re.match(f"{V}{V}|par|col|tap", word):
        rv = 3
    else:
        found = re.search(V, word[1:])
        rv = found.end() + 1 if found else len(word)

    def after(at: int) -> int:
        found = re.compile(f"{V}{C}").search(word, at)
        return found.end() if found else len(word)

    r1 = after(0)
    return min(rv, len(word)), r1, after(r1)


def _standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """(word, whether a verb's ending is still to be looked for) after the endings of nouns, adjectives and adverbs."""
    found = _NOUN.search(w)
    if not found:
        return w, True
    at, end = found.start(), found.group()
    base = w[:at]

    def without(word: str, suffix: str, region: int, otherwise: str | None = None, least: int = 0) -> str:
        """The word without a suffix that stands in the region; else with ``otherwise`` for it, if that may stand there."""
        if not word.endswith(suffix):
            return word
        cut = len(word) - len(suffix)
        return word[:cut] if cut >= region else word[:cut] + otherwise if otherwise is not None and cut >= least else word

    if end in _DELETED:
        return (base, False) if at >= r2 else (w, True)
    if end in _AGENTS:
        return (without(base, "ic", r2, "iqU"), False) if at >= r2 else (w, True)
    if end in REPLACED:
        return (base + REPLACED[end], False) if at >= r2 else (w, True)
    if end in ("ement", "ements"):
        if at < rv:
            return w, True
        if base.endswith("iv"):
            cut = without(base, "iv", r2)
            return (without(cut, "at", r2) if cut != base else base), False
        if base.endswith("eus"):
            return without(base, "eus", r2, "eux", r1), False
        for inner in ("abl", "iqU"):
            if base.endswith(inner):
                return without(base, inner, r2), False
        for inner in ("ièr", "Ièr"):
            if base.endswith(inner) and len(base) - 3 >= rv:
                return base[:-3] + "i", False
        return base, False
    if end in ("ité", "ités"):
        if at < r2:
            return w, True
        for inner, other in (("abil", "abl"), ("ic", "iqU"), ("iv", None)):
            if base.endswith(inner):
                return without(base, inner, r2, other), False
        return base, False
    if end in ("if", "ive", "ifs", "ives"):
        if at < r2:
            return w, True
        cut = without(base, "at", r2)
        return (without(cut, "ic", r2, "iqU") if cut != base else base), False
    if end == "eaux":
        return base + "eau", False
    if end == "aux":
        return (base + "al", False) if at >= r1 else (w, True)
    if end in ("euse", "euses"):
        return (base, False) if at >= r2 else (base + "eux", False) if at >= r1 else (w, True)
    if end in ("issement", "issements"):
        return (base, False) if at >= r1 and re.search(f"{C}$", base) else (w, True)
    if end in ("amment", "emment"):
        return (base + ("ant" if end == "amment" else "ent"), True) if at >= rv else (w, True)
    # -ment behind a vowel of the first region: a verb's ending may stand before it
    return (base, True) if at - 1 >= rv and re.search(f"{V}$", base) else (w, True)


def _verb(w: str, rv: int, r2: int) -> str:
    found = _IR.search(w, rv)
    if found:
        if found.start() - 1 >= rv and re.match(C, w[found.start() - 1]):
            return w[: found.start()]
    found = _VERB.search(w, rv)
    if not found:
        return w
    at, end = found.start(), found.group()
    if end == "ions":
        return w[:at] if at >= r2 else w
    w = w[:at]
    return w[:-1] if end in _VERBS_E and w.endswith("e") and at - 1 >= rv else w


@lru_cache(maxsize=500_000)
def stem(word: str) -> str:
    """What is left of a word in lower case."""
    w = re.sub("qu", "qU", word)
    # vowels that stand for consonants, from left to right
    for k in range(len(w)):
        before, after = k and w[k - 1] in VOWELS + "ù", k + 1 < len(w) and w[k + 1] in VOWELS + "ù"
        if w[k] in "ui" and before and after or w[k] == "y" and (before or after):
            w = w[:k] + w[k].upper() + w[k + 1 :]
    rv, r1, r2 = _regions(w)
    made, open_ = _standard(w, rv, r1, r2)
    if open_:
        ended = _verb(made, rv, r2)
        changed, made = ended != w, ended
    else:
        changed = True
    if changed:
        made = made[:-1] + "i" if made.endswith("Y") else made[:-1] + "c" if made.endswith("ç") else made
    else:
        if re.search("[^aiouès]s$", made):
            made = made[:-1]
        found = re.compile("(?:ion|ier|ière|Ier|Ière|e)$").search(made, rv)
        if found and found.group() == "ion":
            made = made[:-3] if found.start() >= r2 and found.start() - 1 >= rv and made[found.start() - 1] in "st" else made
        elif found:
            made = made[: found.start()] + ("" if found.group() == "e" else "i")
    if re.search("(?:enn|onn|ett|ell|eill)$", made):
        made = made[:-1]
    made = re.sub(f"[éè]({C}+)$", r"e\1", made)
    return made.lower()
