"""Study parameters.  Every operator takes these as arguments; nothing reads them as hidden state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Site:
    """One community: its archive name, the tags that mark its subject, and its relatedness thresholds."""

    alias: str
    archive: str
    anchors: tuple[str, ...]
    threshold_1: float
    threshold_2: float
    denied_tags: tuple[str, ...] = ()


# The communities, their anchors, thresholds and denied tags.
SITES = (
    Site("stackoverflow", "stackoverflow.com.7z", ("cryptography",), 0.05, 0.002, ("asn.1", "bitcoin", "entropy", "javacard", "secret-key", "smartcard")),
    Site("crypto", "crypto.stackexchange.com.7z", ("encryption",), 0.1, 0.001, ("adversarial-model", "complexity", "machine-learning", "matrix-multiplication", "order-preserving", "permutation")),
    Site(
        "security", "security.stackexchange.com.7z", ("cryptography",), 0.05, 0.002,
        (".net", "algorithm", "bitcoin", "brute-force", "compression", "distributed-computing", "drm", "emv", "government", "instant-messaging", "integrity", "library", "nist", "obscurity", "passwords", "programming", "protocols", "quantum-computing", "random", "rfid", "secret-sharing", "side-channel", "smartcard", "theory", "timestamp", "timing-attack", "voip"),
    ),
)

# The grid of thresholds that is swept.
GRID_1 = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
GRID_2 = (0.001, 0.002, 0.005, 0.010, 0.015, 0.020, 0.30)

#: Share of a site's questions that each popularity metric must reach.
POPULARITY_QUANTILE = 0.75

# English function words beyond those that Spark bundles.
FURTHER_STOPWORDS = frozenset("""
across afterwards ain almost alone along already also although always am among amongst amount another anyhow anyone
anything anyway anywhere aren around back became become becomes becoming beforehand behind beside besides beyond bottom
ca call couldn d didn doesn done due eight either eleven else elsewhere empty enough even ever every everyone everything
everywhere except fifteen fifty first five former formerly forty four front full get give go hadn hasn haven hence
however hundred indeed isn keep last latter latterly least less ll m ma made make many may meanwhile might mightn mine
moreover mostly move much must mustn name namely needn neither never nevertheless next nine nobody none noone nothing
nowhere o often one onto others otherwise part per perhaps please put quite rather re really regarding say see seem
seemed seeming seems serious several shan shouldn show side since six sixty somehow someone something sometime sometimes
somewhere still take ten thence therefore third though three throughout thru thus together top toward towards twelve
twenty two unless upon us used using various ve via wasn well weren whatever whence whenever whereas wherever whether
whither whoever whole whose within without won wouldn y yet
""".split()) | {first + last for first in ("here", "there", "where") for last in ("after", "by", "in", "upon")}
# Words of the medium and of discourse, beyond a language's stop words.
MEDIUM_STOPWORDS = frozenset((
    "answer", "question", "post", "comment", "comments", "reply", "replies", "op", "edit", "edited", "link", "links",
    "thread", "update", "updates", "solution", "issue", "issues", "discussion", "discussions",
))
DISCOURSE_STOPWORDS = frozenset((
    "work", "works", "working", "find", "found", "finding", "use", "uses", "using", "used", "make", "makes", "made",
    "get", "gets", "getting", "got", "try", "tries", "trying", "know", "knows", "knowing", "need", "needs", "needed",
    "want", "wants", "wanted", "good", "better", "best", "thing", "things", "point", "points", "problem", "problems",
    "case", "cases", "example", "examples", "people", "someone", "anyone", "everyone",
))

# Programming languages, in the order in which they are looked for.
LANGUAGES = ("Python", "JavaScript", "Java", "PHP", "C++", "C#", "C", "Obj-C", "Go", "Perl", "Ruby", "Delphi", "Powershell", "SQL", "TSQL", "Vbnet", "Lisp", "Lua", "Bash", "R", "Haskell", "Matlab", "Rust")

# Spellings of technologies and the term they count as.
TECHNOLOGY_ALIASES = {
    "aes-128": "aes",
    "aes-256": "aes",
    "rijndael": "aes",
    "aes-ni": "aes",
    "pkcs1": "pkcs",
    "pkcs#1": "pkcs",
    "pkcs5": "pkcs",
    "pkcs#5": "pkcs",
    "pkcs7": "pkcs",
    "pkcs#7": "pkcs",
    "pkcs11": "pkcs",
    "pkcs11.net": "pkcs",
    "pkcs11interop": "pkcs",
    "pkcs12": "pkcs",
    "pkcs#12": "pkcs",
    "sha1": "sha1",
    "sha-1": "sha1",
    "sha256": "sha",
    "sha-256": "sha",
    "sha512": "sha",
    "sha-512": "sha",
    "sha2": "sha",
}

#: Topics a technology must occur in to be cross-cutting, and peak share to be topic-specific.
CROSS_CUTTING_TOPICS = 4
SPECIFIC_PEAK = 8.0
#: Topics of the final model; their ids are 01, 02 and so on.
TOPIC_COUNT = 21
TOPIC_IDS = tuple(f"{k:02d}" for k in range(1, TOPIC_COUNT + 1))

# Themes and the numbers of the topics in them.
TOPIC_THEMES = {
    "Theoretical foundations and learning": (6, 21),
    "Cryptographic primitives and algorithms": (7, 8, 14, 15),
    "Identity management and passwords": (4, 10, 13),
    "Key infrastructure and trust (PKI)": (3, 20),
    "Implementation and software development": (1, 5, 18),
    "Communication and data handling": (2, 9, 11),
    "Security parameters and asset protection": (16, 17),
    "Security engineering and risk analysis": (12, 19),
}


@dataclass(frozen=True)
class TopicModelOptions:
    """Parameters of the topic model and its sweep."""

    topic_counts: tuple[int, ...] = tuple(range(1, 26))
    min_documents: float = 5.0
    max_document_share: float = 0.5
    vocabulary: int | None = 100_000  # None: no bound
    iterations: int = 2000
    alpha_numerator: float = 50.0
    beta: float = 0.01
    seed: int = 7562
    top_words: int = 20

    def default_topic_count(self) -> int:
        return int(sum(self.topic_counts) / len(self.topic_counts))


#: Phrase mining: least count of a phrase, and the score that it must pass.
PHRASE_MIN_COUNT = 5
PHRASE_THRESHOLD = 10.0

#: Sampling at 95 % confidence with an error of 5 points and an expected share of one half.
SAMPLE_Z, SAMPLE_P, SAMPLE_E = 1.96, 0.5, 0.05

#: Chance agreement of two raters, and rows of the first pair of raters.
CHANCE_AGREEMENT = 0.5
FIRST_PAIR_ROWS = 177
