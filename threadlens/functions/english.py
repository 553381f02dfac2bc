"""A small labelled table of English: words by part of speech, their forms by rule, and sentences by pattern.

It is what the tagger and the lemmas learn from unless a user gives a table of
their own.  Forms and sentences are drawn by rule from the lists below.
"""

from __future__ import annotations

import random

#: Parts of speech, and the letters that stand for them in labelled sentences.
TAGS = {"N": "NOUN", "P": "PROPN", "V": "VERB", "X": "AUX", "A": "ADJ", "R": "ADV", "O": "PRON", "D": "DET", "I": "ADP", "C": "CONJ", "M": "NUM", "T": "PART", "U": "X"}

VERBS = """encrypt decrypt sign verify store send receive generate compute hash derive exchange protect attack break guess leak share trust revoke
authenticate authorize log read write copy delete create update change add remove call return parse compile run start stop open close load save check test
compare match search sort index insert merge split join connect listen wait retry fail succeed pass require allow deny grant accept reject believe think
explain describe understand learn teach suggest recommend ask answer claim prove show see say tell give take keep put set let move turn choose decide
avoid prevent reduce increase improve replace implement support provide contain include exist depend happen appear remain use need want try make get go come find
pad plan drop tag plug ship map skip swap trim wrap scan step strip cache help offer expect seem work repeat publish configure"""
NOUNS = """key cipher password certificate signature message block mode user server client attacker protocol algorithm hash salt token session file
byte string integer number value function method class object array list table database query index system network device browser application library
code program error bug test answer question problem solution way time day year case reason result idea point example part piece line page site
person team company customer product service account email address phone card bank country city world house car book paper letter word language
status virus bonus process access success analysis basis news kind chain source default practice note manager generator difference force
security privacy trust risk attack threat defence access policy rule law right size length strength speed memory disk processor cache"""
ADJECTIVES = """secure safe weak strong public private secret random new old large small big long short high low fast slow good bad great easy hard simple
different same similar common rare possible impossible necessary useful important main correct wrong true false empty full open free ready sure clear
current recent early late local remote symmetric asymmetric cryptographic digital personal additional standard typical vulnerable reliable careful"""
ADVERBS = """very too quite rather almost already still yet now then here there always never often sometimes usually soon again once maybe perhaps
however therefore instead together apart away back even just only really actually probably simply directly exactly quickly slowly safely easily"""
PROPERS = """Alice Bob Java Python Linux Windows Google Amazon Mozilla Android Chrome Firefox Berlin London Paris France Germany Spain Maria John Peter
OpenSSL RSA AES SHA TLS SSL HTTPS GPG Monday January"""
CLOSED = {
    "D": "the a an this that these those each every some any no another both all which what my your his its our their",
    "O": "i you he she it we they me him her us them who someone anyone everyone something anything nothing mine yours myself itself themselves whoever",
    "I": "of in to for on with at by from about as into like through after over between out against during without before under around among within upon than via per since until despite behind across",
    "C": "and or but nor because if when while although though whether unless whereas where that so",
    "X": "is are was were be been being am has have had do does did will would can could may might must shall should cannot cant dont doesnt didnt isnt arent wont",
    "T": "to not",
    "M": "one two three four five six seven eight nine ten hundred thousand million",
    "U": "please thanks hello yes no hi etc",
}

# Irregular verbs, as base, past, participle.
IRREGULAR_VERBS = """be was been, become became become, begin began begun, break broke broken, bring brought brought, build built built, buy bought bought,
catch caught caught, choose chose chosen, come came come, do did done, draw drew drawn, eat ate eaten, fall fell fallen, feel felt felt, find found found,
forget forgot forgotten, get got gotten, give gave given, go went gone, grow grew grown, have had had, hear heard heard, hide hid hidden, hold held held,
keep kept kept, know knew known, lead led led, leave left left, lose lost lost, make made made, mean meant meant, meet met met, pay paid paid,
put put put, read read read, run ran run, say said said, see saw seen, sell sold sold, send sent sent, set set set, show showed shown, speak spoke spoken,
spend spent spent, stand stood stood, steal stole stolen, take took taken, teach taught taught, tell told told, think thought thought,
understand understood understood, write wrote written, let let let, split split split, wear wore worn, win won won"""
IRREGULAR_PRESENT = "am be, are be, is be, has have, does do"
# Irregular plurals and comparisons, each with its lemma.
IRREGULAR_NOUNS = "men man, women woman, children child, people people, feet foot, teeth tooth, mice mouse, indices index, matrices matrix, vertices vertex, criteria criterion, data datum, keys key, analyses analysis, bases basis"
IRREGULAR_COMPARISONS = "better good, best good, worse bad, worst bad, less little, least little, more much, most much, further far"

VOWELS = "aeiou"


def doubles(verb: str) -> bool:
    """True if the last consonant doubles before -ed and -ing: one syllable of consonant, vowel, consonant."""
    short = sum(c in VOWELS for c in verb) == 1
    return short and len(verb) > 2 and verb[-1] not in VOWELS + "wxy" and verb[-2] in VOWELS and verb[-3] not in VOWELS


def with_s(word: str) -> str:
    if word.endswith("y") and word[-2] not in VOWELS:
        return word[:-1] + "ies"
    return word + ("es" if word.endswith(("s", "x", "z", "ch", "sh")) or word in ("go", "do") else "s")


def with_ed(verb: str) -> str:
    if verb.endswith("e"):
        return verb + "d"
    if verb.endswith("y") and verb[-2] not in VOWELS:
        return verb[:-1] + "ied"
    return verb + (verb[-1] if doubles(verb) else "") + "ed"


def with_ing(verb: str) -> str:
    if verb.endswith("e") and verb != "be" and not verb.endswith(("ee", "ye", "oe")):
        return verb[:-1] + "ing"
    return verb + (verb[-1] if doubles(verb) else "") + "ing"


def compared(adjective: str, end: str) -> str:
    if adjective.endswith("e"):
        return adjective + end[1:]
    if adjective.endswith("y"):
        return adjective[:-1] + "i" + end
    return adjective + (adjective[-1] if doubles(adjective) else "") + end


def irregular_verbs() -> dict[str, tuple[str, str]]:
    return {b: (p, n) for b, p, n in (x.split() for x in IRREGULAR_VERBS.split(","))}


def irregular(pairs: str) -> dict[str, str]:
    return dict(x.split() for x in pairs.split(","))


def forms() -> list[tuple[str, str, str]]:
    """(form, part of speech, lemma) of the open classes, by rule."""
    odd = irregular_verbs()
    out = [(f, "VERB", v) for v in VERBS.split() for f in (v, with_s(v), with_ing(v), *([] if v in odd else [with_ed(v)]))]
    out += [(f, "NOUN", n) for n in NOUNS.split() for f in (n, with_s(n))]
    out += [(a, "ADJ", a) for a in ADJECTIVES.split()]
    out += [(compared(a, end), "ADJ", a) for a in ADJECTIVES.split() if sum(c in VOWELS for c in a) < 3 and len(a) < 7 for end in ("er", "est")]
    return out + [(r, "ADV", r) for r in ADVERBS.split()]


def irregular_forms() -> list[tuple[str, str, str]]:
    """(form, part of speech, lemma) of words that follow no rule."""
    out = [(f, "VERB", b) for b, pair in irregular_verbs().items() for f in (b, *pair, with_ing(b), *([] if b in ("be", "have", "do") else [with_s(b)]))]
    out += [(f, "VERB", b) for f, b in irregular(IRREGULAR_PRESENT).items()]
    out += [(f, "NOUN", b) for f, b in irregular(IRREGULAR_NOUNS).items()]
    return out + [(f, pos, b) for f, b in irregular(IRREGULAR_COMPARISONS).items() for pos in ("ADJ", "ADV")]


# Sentences as patterns: a letter draws a word of that part of speech, a word stands for itself with the letter behind the slash.
# Small letters ask for a form: v base, z with s, g with ing, d past, n participle, N noun, S plural.
PATTERNS = """D N X n I D A N|O X v D N|D A S v D N|O d D N I D N|T/to v D N O v D N|how/R X O v D A N|what/O X D N I S|D N z A S|there/O X M S I D N
O X R A|D N X R A I N|g D N X A|O X not/T v why/R D N X A|if/C D N X n D N X v|P z D N|O X g P I N|D S X n I P and/C P|R O X v D N|O v that/C D N X A
v D N I D N|A N I N X R n|O R v S|D N that/O z D N X A|O d O I D N|when/C O v D N O z|D N of/I D N X D A N|S and/C S X A|O X T/to v D N|A S X R A T/to v
the/D g N X n I D N|D N n I D N X A|O X v I P|D M S X n|as/I A as/I D N|O v R|which/D N X O v|T/to v or/C not/T T/to v|O X n D N R|R D N z D N C z I O
D N N X A|D A N N z D N|O v D N N I S|N N X A I D N|where/R X D S n|X O v D N I O|X D N A|X O n D N"""


def sentences(n: int, seed: int = 7, leave: frozenset[str] = frozenset()) -> list[list[tuple[str, str]]]:
    """``n`` labelled sentences drawn from the patterns; words of ``leave`` (base forms) are not used."""
    rng, odd = random.Random(seed), irregular_verbs()
    words = {"v": VERBS, "N": NOUNS, "A": ADJECTIVES, "R": ADVERBS, "P": PROPERS} | CLOSED
    pools = {k: [w for w in x.split() if w not in leave] for k, x in words.items()}
    patterns = [p.split() for p in PATTERNS.replace("\n", "|").split("|")]

    def word(slot: str) -> tuple[str, str]:
        if "/" in slot:
            w, k = slot.split("/")[::-1] if len(slot.split("/")[0]) == 1 and slot[0].isupper() else slot.split("/")
            return w, TAGS[k]
        if slot in "zgdn":
            v = rng.choice(pools["v"])
            past, done = odd.get(v, (with_ed(v), with_ed(v)))
            return {"z": with_s(v), "g": with_ing(v), "d": past, "n": done}[slot], "VERB"
        if slot == "S":
            return with_s(rng.choice(pools["N"])), "NOUN"
        if slot == "A" and rng.random() < 0.1:
            return compared(rng.choice([a for a in pools["A"] if len(a) < 6]), "er"), "ADJ"
        if slot == "R" and rng.random() < 0.4:
            return rng.choice([a for a in pools["A"] if not a.endswith(("y", "le", "ue"))]) + "ly", "ADV"
        if slot not in pools:
            return slot, TAGS["R"]
        return rng.choice(pools[slot]), TAGS.get(slot, "VERB")

    out = []
    for _ in range(n):
        one = [word(s) for s in rng.choice(patterns)]
        if rng.random() < 0.7 and one[0][0] != "i":
            one[0] = (one[0][0].capitalize(), one[0][1])
        out.append(one)
    return out


# Labelled sentences, as word/letter.
EXAMPLES = """I/O am/X trying/V to/T understand/V how/R the/D key/N exchange/N works/V in/I practice/N
What/O is/X the/D best/A way/N to/T store/V user/N passwords/N in/I a/D database/N
You/O should/X never/R use/V the/D same/A key/N twice/R with/I a/D stream/N cipher/N
Is/X it/O safe/A to/T send/V the/D salt/N along/R with/I the/D hash/N
The/D attacker/N can/X easily/R guess/V short/A passwords/N because/C they/O have/X low/A entropy/N
As/C far/R as/C I/O know/V this/D mode/N is/X no/R longer/R recommended/V
My/D application/N reads/V a/D file/N and/C then/R encrypts/V it/O using/V AES/P
If/C you/O need/V authentication/N you/O must/X add/V a/D signature/N or/C a/D MAC/N
There/O are/X many/A different/A reasons/N why/R such/A systems/N fail/V
I/O have/X read/V that/C RSA/P keys/N should/X be/X at/I least/A 2048/M bits/N long/A
The/D server/N returned/V an/D error/N when/C I/O tried/V to/T open/V the/D connection/N
Can/X anyone/O explain/V what/O this/D function/N actually/R does/V
It/O depends/V on/I the/D size/N of/I the/D message/N and/C the/D strength/N of/I the/D password/N
We/O generate/V a/D new/A random/A number/N for/I each/D session/N
Alice/P sends/V Bob/P her/D public/A key/N over/I an/D insecure/A channel/N
Using/V a/D slow/A hash/N makes/V brute/A force/N attacks/N more/R expensive/A
Please/U note/V that/C the/D test/N results/N were/X not/T verified/V
Does/X Java/P support/V this/D kind/N of/I encryption/N by/I default/N
They/O wanted/V to/T sign/V the/D document/N digitally/R before/I sending/V it/O
The/D most/R common/A mistake/N is/X reusing/V the/D initialization/N vector/N
He/O said/V the/D implementation/N looked/V correct/A but/C was/X vulnerable/A to/I timing/N attacks/N
How/R do/X I/O convert/V a/D string/N to/I bytes/N in/I Python/P
A/D good/A answer/N would/X also/R describe/V the/D risks/N
Your/D code/N leaks/V the/D private/A key/N through/I the/D log/N file/N
Modern/A browsers/N reject/V weak/A certificates/N automatically/R
It/O is/X computationally/R infeasible/A to/T find/V two/M messages/N with/I the/D same/A hash/N
I/O would/X prefer/V a/D simpler/A design/N with/I fewer/A dependencies/N
Several/A people/N suggested/V that/C I/O move/V the/D secret/N out/I of/I the/D code/N
The/D previous/A version/N stored/V plain/A text/N credentials/N locally/R
Someone/O asked/V how/R the/D handshake/N prevents/V replay/N attacks/N
Some/D vendors/N ship/V devices/N with/I default/A passwords/N
Both/D parties/N agree/V on/I a/D shared/A secret/N before/C they/O start/V talking/V
This/D post/N covers/V only/R basic/A concepts/N
Nothing/O stops/V an/D insider/N from/I copying/V the/D backup/N tapes/N
The/D documentation/N mentions/V three/M modes/N but/C does/X not/T compare/V them/O well/R
Would/X it/O make/V sense/N to/T rotate/V keys/N every/D month/N
Old/A clients/N still/R expect/V the/D legacy/A format/N
Error/N handling/N matters/V as/R much/R as/C raw/A speed/N
We/O finally/R traced/V the/D leak/N to/I a/D misconfigured/A proxy/N
His/D team/N maintains/V an/D open/A source/N password/N vault/N
Never/R roll/V your/D own/A crypto/N unless/C you/O really/R have/V to/T
Hash/N functions/N map/V long/A inputs/N to/I short/A fixed/A outputs/N"""


def examples(text: str = EXAMPLES) -> list[list[tuple[str, str]]]:
    return [[(w.rpartition("/")[0], TAGS[w.rpartition("/")[2]]) for w in line.split()] for line in text.splitlines()]
