"""Text functions as Columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a change that name a risk; of its subject, those that say that it only looks like one, and what
#: then doesn't count.
RISK = r"(?i)\b(revert(?:ed|s)?|hot-?fix|fix(?:es|ed)?|bug|regression|incident|outage|rollback|roll back|security|cve-\d+|vuln|crash|data loss|race condition|deadlock|leak)\b"
COSMETIC = r"(?i)\b(?:typos?|spelling|docs?|documentation|readme|changelog|lint(?:ing)?|format(?:ting)?|style|whitespace|comments?|wording|grammar)\b"
NO_RISK = ("fix", "fixes", "fixed", "bug")
#: Suffixes that the light stemmer takes off, the longest first.
SUFFIXES = ("ingly", "edly", "ing", "ers", "ies", "ied", "ed", "es", "er", "ly", "s")
#: Words that say nothing about what a statement is about.
FUNCTION_WORDS = """
a an the and or but if then else of in on at to for from by with without as is are was were be been being
it its this that these those we you they he she i me my our your their them us not no nor do does did done
has have had will would should shall can could must may might so than too very all any each every only also
into onto over about after before when where which who whom what how there here via per just
""".split()
#: Families of languages by a file's extension.
FAMILIES = {"py": "python", "pyi": "python", "js": "web", "jsx": "web", "ts": "web", "tsx": "web", "mjs": "web", "java": "jvm", "kt": "jvm", "scala": "jvm", "c": "native", "h": "native", "cc": "native", "cpp": "native", "hpp": "native", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "dotnet", "sql": "sql"}
#: Kinds of files by extension.
CATEGORIES = {"md": "document", "rst": "document", "txt": "document", "pdf": "paper", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "svg": "image", "json": "config", "toml": "config", "yaml": "config", "yml": "config"}


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def split_identifiers(text: Column) -> Column:
    """camelCase, snake_case and kebab-case apart."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")


def stem(word: Column) -> Column:
    """Take off the longest known suffix if more than two letters stay."""
    out = word
    for suffix in reversed(SUFFIXES):
        k = len(suffix)
        out = F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) > k + 2), F.left(word, F.length(word) - k)).otherwise(out)
    return out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def key(label: Column) -> Column:
    """The join key of a label: lower case, runs of other signs as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def risk_tags(subject: Column, body: Column | None = None) -> Column:
    """Sorted names of the risks that a change's subject and body speak of, as whole words; of a fix to wording, comments or
    style the fix doesn't count. Null counts as empty."""
    subject = F.coalesce(subject, F.lit(""))
    text = F.concat(subject, F.lit("\n"), F.coalesce(body, F.lit("")) if body is not None else F.lit(""))
    found = F.transform(F.regexp_extract_all(text, F.lit(RISK), F.lit(1)), lambda x: F.replace(F.split(F.lower(x), "-")[0], F.lit(" "), F.lit("_")))
    plain = F.when(subject.rlike(COSMETIC), F.filter(found, lambda x: ~x.isin(*NO_RISK))).otherwise(found)
    return F.array_sort(F.array_distinct(F.concat(plain, F.when(subject.rlike(r"(?i)\brevert"), F.array(F.lit("revert"))).otherwise(F.array().cast("array<string>")))))


def trailers(body: Column, name: str) -> Column:
    """The values of ``Name: value`` lines."""
    return F.regexp_extract_all(body, F.lit(f"(?m)^{name}: *(\\S+) *$"), F.lit(1))


def strip_html(html: Column) -> Column:
    for pattern in ("(?is)<(script|style)[^>]*>.*?</(script|style)>", "(?s)<!--.*?-->", "<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return squeeze(html)


def strip_tags(text: Column, names: tuple[str, ...] = ("private", "system")) -> Column:
    """Without the content of named tags."""
    for name in names:
        text = F.regexp_replace(text, f"(?s)<{name}>.*?</{name}>", "")
    return F.trim(text)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1)), "^www\\.", "")


def tokens(text: Column) -> Column:
    """A rough count: a token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def content(words: Column) -> Column:
    """The words that aren't function words, or all if there are no others."""
    kept = F.filter(words, lambda x: ~x.isin(*FUNCTION_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def overlap(a: Column, b: Column) -> Column:
    """Shared words over those of the shorter array, as sets; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def same_fact(a: Column, b: Column) -> Column:
    """Whether two texts say the same: equal but for case and blanks, or three fifths of all words shared."""
    return (F.lower(squeeze(a)) == F.lower(squeeze(b))) | (jaccard(words(a), words(b)) >= 0.6)


def containment(a: Column, b: Column) -> Column:
    """Shared over the smaller set."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def density(text: Column) -> Column:
    """Capitalised words for 1000 tokens."""
    return 1000 * F.regexp_count(text, F.lit("(^|[ \n])[A-Z]")) / tokens(text)


def lucene_escape(text: Column) -> Column:
    return F.regexp_replace(text, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def epoch_millis(n: Column) -> Column:
    """Seconds or milliseconds, told apart by size."""
    return F.timestamp_millis(F.when(n > 100_000_000_000, n).otherwise(n * 1000).cast("long"))


def recency(age_days: Column, half_life: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return -F.aggregate(F.transform(F.array_distinct(chars), lambda c: share(c) * F.log2(share(c))), F.lit(0.0), lambda s, x: s + x)


def plain_letters(text: Column) -> Column:
    """Latin letters without their marks. The letters of Latin-1 and Latin Extended-A that have one."""
    marked, bare = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīŁłŃńŇňŌōŐőŘřŚśŞşŠšŤťŪūŮůŰűŹźŻżŽž", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiLlNnNnOoOoRrSsSsSsTtUuUuUuZzZzZz"
    return F.translate(text, marked, bare)


def lemmas(text: Column) -> Column:
    """Words for BM25: identifiers apart, function words left out, stems."""
    found = words(split_identifiers(text))
    return F.transform(F.filter(found, lambda x: ~x.isin(*FUNCTION_WORDS)), stem)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def _by_extension(path: Column, known: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in known.items() for x in item]), extension(path)), F.lit(other))


def family(path: Column) -> Column:
    """The family of a file's language, ``other`` if unknown."""
    return _by_extension(path, FAMILIES, "other")


def category(path: Column) -> Column:
    """code, document, paper, image, config or other."""
    return F.when(family(path) != "other", "code").otherwise(_by_extension(path, CATEGORIES, "other"))


def longest_prefix(name: Column, prices: dict[str, float]) -> Column:
    """The value of the longest key that ``name`` begins with; null if none does."""
    out = F.lit(None).cast("double")
    for k in sorted(prices, key=len):
        out = F.when(F.startswith(name, F.lit(k)), F.lit(float(prices[k]))).otherwise(out)
    return out


def densest_window(text: Column, keywords: list[str], size: int, steps: int = 40) -> Column:
    """(at, hits): where a window of ``size`` characters has most occurrences of ``keywords``, the first of equal ones."""
    n = F.length(text)
    step = F.greatest(F.lit(1), ((n - size) / steps).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - size), step)
    low = F.lower(text)
    part = lambda at: F.substr(low, at + 1, F.lit(size))
    hits = lambda at: sum(((F.length(part(at)) - F.length(F.replace(part(at), F.lit(k), F.lit("")))) / len(k)).cast("int") for k in keywords)
    found = F.transform(starts, lambda at: F.struct(hits(at).alias("hits"), (-at).alias("back")))
    best = F.array_max(found)
    return F.struct((-best["back"]).alias("at"), best["hits"].alias("hits"))


def edit_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment of two short words: Levenshtein with swaps of neighbours, one row of the table at a time. Words
    that are one letter apart, or equal, have no swap that is shorter, and get plain Levenshtein, which the engine has itself."""
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    y = letters(b)

    def row(acc, c):
        # acc: the two rows before, the letter before, and how many rows are done.
        def cell(done, j):
            up, left, corner = F.get(acc["now"], j), F.element_at(done, -1), F.get(acc["now"], j - 1)
            plain = F.least(up + 1, left + 1, corner + F.when(F.get(y, j - 1) == c, 0).otherwise(1))
            swap = (j >= 2) & (acc["n"] >= 1) & (F.get(y, j - 2) == c) & (F.get(y, j - 1) == acc["c"])
            return F.concat(done, F.array(F.when(swap, F.least(plain, F.get(acc["old"], j - 2) + 1)).otherwise(plain)))

        grown = F.when(F.size(y) == 0, F.array(acc["n"] + 1)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(y), F.lit(1))), F.array(acc["n"] + 1), cell))
        return F.struct(acc["now"].alias("old"), grown.alias("now"), c.alias("c"), (acc["n"] + 1).alias("n"))

    first = F.sequence(F.lit(0), F.size(y))
    start = F.struct(first.alias("old"), first.alias("now"), F.lit("").alias("c"), F.lit(0).alias("n"))
    plain = F.levenshtein(a, b)
    return F.when(plain <= 1, plain).otherwise(F.aggregate(letters(a), start, row, lambda acc: F.element_at(acc["now"], -1)))
