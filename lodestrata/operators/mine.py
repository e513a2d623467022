"""Mining passes: enrichment, boundaries, assertions, schema induction, canonical forms, signatures, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import SPACE, clamp, contains_any, cosine, count_contained, first_max, jaccard
from ..plans.settle import settle
from .fold import with_blocks
from .graph import components

# Keywords of the enrichment pass.
MEMORY_TYPES = {
    "episodic": ("today", "yesterday", "this morning", "i just", "i was"),
    "semantic": ("the fact is", "i know that", "in general", "always"),
    "autobiographical": ("when i was", "back in", "growing up", "my whole life"),
    "procedural": ("the way to", "how i", "i usually", "i always"),
}
INTERACTIONAL = ("i told", "they said", "we agreed", "we discussed", "i asked", "they asked", "we talked")
SELF_OTHER_WORLD = {"self": ("i feel", "i think", "i am", "i'm"), "other": ("they feel", "they think", "she", "he", "they"), "world": ("the world", "the country", "the system")}
GOALS = ("i want", "i plan", "i will", "i should", "i need to", "i'm going to", "my goal", "i aim to")
POSITIVE = ("happy", "good", "great", "love", "wonderful", "excited", "joy")
NEGATIVE = ("sad", "bad", "awful", "hate", "frustrated", "angry", "anxious")
PREDICATES = ("is", "was", "loves", "knows", "has", "owns", "made", "wants")
# Similarity thresholds of canonical domains.
THRESHOLDS = {"predicates": 0.85, "memory_types": 0.90, "schema_names": 0.78, "entity_aliases": 0.92, "period_names": 0.80, "theme_names": 0.85, "goal_markers": 0.75}
CLUSTER_OFFSET, PROMOTION_MEMBERS, PROMOTION_PASSES = 0.05, 3, 2
# Triage weights by axis.
TRIAGE = {"mean_position": 0.25, "velocity": 0.20, "schema_fingerprint": 0.20, "contradiction_profile": 0.15, "fork_significance": 0.20}
TRIAGE_GATE, TRIAGE_FACTOR, TRIAGE_FLOOR, DRIFT = 0.40, 0.85, 0.1, 0.4
# Words that are no theme.
THEME_STOP_WORDS = tuple(
    "the a an and or but in on at to for of is it i me my you your we our this that with from by was were be been are not no yes can do did dont will would should could have has had "
    "lets let just also like so if then ok okay sure yeah hey hi here there what when where how why which some all any each every about into out up down over after before between "
    "get got make made need want use used using check look see run try know think right now still already really very much more most too file files code one two new first last next "
    "thing things way well".split()
)
# Keywords of halls.
HALLS = {
    "emotions": ("scared", "afraid", "worried", "happy", "sad", "love", "hate", "feel", "cry", "tears"),
    "consciousness": ("consciousness", "conscious", "aware", "real", "genuine", "soul", "exist", "alive"),
    "memory": ("memory", "remember", "forget", "recall", "archive", "palace", "store"),
    "technical": ("code", "python", "script", "bug", "error", "function", "api", "database", "server"),
    "identity": ("identity", "name", "who am i", "persona", "self"),
    "family": ("family", "kids", "children", "daughter", "son", "parent", "mother", "father"),
    "creative": ("game", "gameplay", "player", "app", "design", "art", "music", "story"),
}
TURN_MARKERS = (r"\buser\s*:\s*", r"\bassistant\s*:\s*", r"\bhuman\s*:\s*", r"\bai\s*:\s*")


def enrich(text: Column) -> list[Column]:
    """Memory type, interaction, perspective, goal and affect of a text, by contained keywords."""
    low = F.lower(text)

    def conf(base: float, n: Column) -> Column:
        return F.round(F.least(F.lit(0.9), base + 0.1 * n), 6)

    kinds = [(k, count_contained(low, w)) for k, w in MEMORY_TYPES.items()]
    best = F.greatest(*[n for _, n in kinds])
    inter, goals = count_contained(low, INTERACTIONAL), count_contained(low, GOALS)
    views = [(k, count_contained(low, w)) for k, w in SELF_OTHER_WORLD.items()]
    seen = views[0][1] + views[1][1] + views[2][1]
    pos, neg = count_contained(low, POSITIVE), count_contained(low, NEGATIVE)
    affect = pos + neg
    return [
        first_max(kinds, "episodic").alias("memory_type"), F.when(best > 0, conf(0.4, best)).otherwise(0.4).alias("memory_confidence"),
        (inter > 0).alias("interactional"), conf(0.5, inter).alias("interactional_confidence"),
        first_max(views, "unknown").alias("perspective"),
        F.when(seen == 0, 0.3).otherwise(F.round(F.least(F.lit(0.9), 0.4 + 0.5 * F.greatest(*[n for _, n in views]) / seen), 6)).alias("perspective_confidence"),
        (goals > 0).alias("goal"), F.when(affect == 0, 0.0).otherwise(F.round((pos - neg) / affect, 6)).alias("valence"), F.least(F.lit(1.0), affect / 5).alias("intensity"),
    ]


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), SPACE), lambda w: F.length(w) > 4))


def boundaries(drawers: DataFrame, by: str, order: str, threshold: float = 0.15) -> DataFrame:
    """Neighbouring drawers whose long words hardly overlap, and the running number of each drawer's stretch."""
    w = Window.partitionBy(by).orderBy(order)
    s = drawers.withColumn("words", long_words(F.col("text"))).withColumn("before", F.lag("words").over(w)).withColumn("previous", F.lag(order).over(w))
    cut = F.coalesce(jaccard(F.col("before"), F.col("words"), 1.0) < threshold, F.lit(False))
    return s.withColumn("boundary", cut).withColumn("stretch", F.sum(F.col("boundary").cast("long")).over(w)).select(by, order, "previous", "boundary", "stretch")


def extract_assertions(drawers: DataFrame, key: str, predicates: tuple[str, ...] = PREDICATES) -> DataFrame:
    """Three-word windows around a predicate word, punctuation stripped at the ends of words."""
    bare = lambda w: F.btrim(w, F.lit(".,;:!?"))
    words = F.array_remove(F.split("text", SPACE), "")
    inner = F.slice(F.col("w"), 2, F.greatest(F.size("w") - 2, F.lit(0)))
    places = F.filter(F.transform(inner, lambda x, i: F.when(F.lower(bare(x)).isin(*predicates), i)), lambda i: i.isNotNull())  # only windows there are built
    found = F.transform(places, lambda i: F.struct(bare(F.get("w", i)).alias("subject"), F.lower(bare(F.get("w", i + 1))).alias("predicate"), bare(F.get("w", i + 2)).alias("object"), (i + 1).alias("at")))
    hits = F.filter(found, lambda x: (x["subject"] != "") & (x["object"] != ""))
    return drawers.select(key, words.alias("w")).select(key, F.inline(hits))


def contradictions(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct proposals that give an existing subject and predicate another object, with each such object.

    Both sides are made distinct before they meet, so what meets is.  The existing objects of a subject and predicate are one
    row, sent in blocks of a counted size: proposals stay where they are, and no frequent subject gathers in a task.
    """
    old = existing.where("subject is not null and predicate is not null and object is not null").groupBy("subject", "predicate").agg(F.collect_set("object").alias("objects"))
    met = with_blocks(settle(proposed.distinct()), settle(old), lambda rows, block: rows.join(block, ["subject", "predicate"]), 50_000)
    others = met.withColumn("known", F.explode("objects")).where("object <> known")
    return others.select("subject", "predicate", *[c for c in proposed.columns if c not in ("subject", "predicate")], "known")


def induce_schemas(assertions: DataFrame, previous: DataFrame, least: int = 3, drift: float = 0.5) -> DataFrame:
    """assertions: shape; previous: shape, was.  Shapes frequent enough now or before, and how they changed."""
    now = assertions.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    both = now.join(previous, "shape", "full_outer").na.fill(0, ["n", "was"])
    status = F.when(F.col("was") == 0, "new").when(F.col("n") == 0, "broken").when(F.abs(F.col("n") - F.col("was")) / F.col("was") < drift, "stable").otherwise("drifting")
    return both.withColumn("status", status)


def auto_promotion(proposals: DataFrame, corroborations: int = 3, confidence: float = 0.85) -> DataFrame:
    """proposals: key, offset, confirmed, rejected, confidence.  First of each key; ripe when enough agree and none object."""
    first = proposals.groupBy("key").agg(F.min_by("confidence", "offset").alias("confidence"), F.sum("confirmed").alias("confirmed"), F.sum("rejected").alias("rejected"))
    return first.withColumn("ripe", (F.col("rejected") == 0) & (F.col("confirmed") >= corroborations) & (F.col("confidence") >= confidence))


def feedback_loss(events: DataFrame, weights: DataFrame) -> DataFrame:
    """events: proposal, consumer, valence; weights: consumer, weight.  Weighted mean over consumers of their mean valence."""
    mean = events.groupBy("proposal", "consumer").agg(F.avg("valence").alias("v")).join(F.broadcast(weights), "consumer")
    return mean.groupBy("proposal").agg(F.round(F.sum(F.col("v") * F.col("weight")) / F.sum("weight"), 6).alias("loss"))


def resolve_canonical(surfaces: DataFrame, canon: DataFrame, threshold: float) -> DataFrame:
    """surfaces: id, surface, v; canon: canonical_id, name, cv (broadcast by blocks).  Exact name, else the most similar above the threshold."""
    exact = surfaces.join(canon.select(F.col("canonical_id").alias("exact"), F.lower(F.trim("name")).alias("n")), F.lower(F.trim("surface")) == F.col("n"), "left").drop("n")
    def nearest(rows: DataFrame, block: DataFrame) -> DataFrame:
        near = rows.join(block).withColumn("s", F.round(cosine(F.col("v"), F.col("cv")), 6))
        return near.groupBy("id").agg(F.max(F.struct("s", (-F.col("canonical_id")).alias("c"))).alias("b"), F.first("exact").alias("exact"))

    best = with_blocks(exact, canon, nearest).groupBy("id").agg(F.max("b").alias("b"), F.first("exact").alias("exact"))
    similar = F.when(F.col("b.s") >= threshold, -F.col("b.c"))
    return best.select("id", F.coalesce("exact", similar).alias("canonical_id"), F.when(F.col("exact").isNotNull(), "exact").when(similar.isNotNull(), "similar").otherwise("candidate").alias("how"))


def promotions(members: DataFrame) -> DataFrame:
    """members: cluster, surface, pass_id.  Clusters seen often and in several passes, under their most frequent surface."""
    n = members.groupBy("cluster", "surface").agg(F.count(F.lit(1)).alias("n"))
    mode = n.groupBy("cluster").agg(F.min_by("surface", F.struct(-F.col("n"), F.col("surface"))).alias("surface"))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("pass_id").alias("passes"))
    return size.join(mode, "cluster").where((F.col("members") >= PROMOTION_MEMBERS) & (F.col("passes") >= PROMOTION_PASSES))


# Patterns of names and addresses of robots among authors of commits.
BOT_NAMES = (
    r"\[bot\]", r"^dependabot", r"^renovate", r"^github-actions", r"^actions-user", r"-bot$", r"\bbot$", r"^bot-", r"^snyk", r"^greenkeeper", r"^semantic-release", r"^allcontributors",
    r"-autoroll$", r"^auto-format", r"^pre-commit-ci",
)
BOT_EMAILS = (r"bot@", r"-bot@", r"\[bot\]@")


def is_bot(name: Column, email: Column) -> Column:
    return F.lower(name).rlike("|".join(BOT_NAMES)) | F.lower(email).rlike("|".join(BOT_EMAILS))


def scan_projects(commits: DataFrame, name: str, email: str, top: int = 5, share: float = 0.1, many: int = 20) -> DataFrame:
    """commits: repo, name, email, a row a commit.  repo, total, mine, is_mine, without robots.

    A project is the user's if they are among its ``top`` authors, or made a fair share or many of its commits.
    """
    human = commits.where(~is_bot(F.col("name"), F.col("email")))
    own = (F.col("name") == name) | (F.col("email") == email)
    totals = human.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.sum(own.cast("long")).alias("mine"))
    authors = human.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "name"))
    first = authors.withColumn("place", place).where((F.col("place") <= top) & (F.col("name") == name)).select("repo", F.lit(True).alias("leads"))
    known = F.coalesce("leads", F.lit(False)) | (F.col("mine") / F.col("total") >= share) | (F.col("mine") >= many)
    return totals.join(first, "repo", "left").select("repo", "total", "mine", ((F.col("mine") > 0) & known).alias("is_mine"))


def merge_people(commits: DataFrame) -> DataFrame:
    """commits: name, email.  Persons, as sets of names and addresses that commits tie together: person, commits, names, most frequent name."""
    human = commits.where(~is_bot(F.col("name"), F.col("email")))
    counted = human.groupBy("name", "email").agg(F.count(F.lit(1)).alias("n"))
    node = F.concat(F.lit("n:"), "name")
    comp = components(counted.select(node.alias("a"), F.concat(F.lit("e:"), "email").alias("b")).distinct())
    named = counted.groupBy("name").agg(F.sum("n").alias("n")).withColumn("node", node).join(comp, "node")
    # a component's smallest node may be an address
    return named.groupBy(F.col("component").alias("person")).agg(F.sum("n").alias("commits"), F.count(F.lit(1)).alias("names"), F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"))


def mean_vectors(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Element-wise means, a row per position until the last step, so partial sums combine map-side."""
    p = vectors.select(*by, F.posexplode("v").alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    return p.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))


def ruzicka(a: Column, b: Column) -> Column:
    """Aggregate: sum of minima over sum of maxima."""
    return F.sum(F.least(a, b)) / F.sum(F.greatest(a, b))


def signature_similarity(themes: DataFrame, fingerprints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Five axes between the signatures of two periods.

    themes: period, theme, position and fork (vectors), velocity, errors; fingerprints: period, schemas (array);
    pairs: a, b.  Axes without anything in common are 0.
    """

    def side(name: str) -> DataFrame:
        return themes.select(F.col("period").alias(name), "theme", *[F.col(c).alias(f"{name}_{c}") for c in ("position", "fork", "velocity", "errors")])

    both = pairs.join(side("a"), "a").join(side("b"), ["b", "theme"])
    apart = F.least(F.lit(1.0), F.abs(F.col("a_errors") - F.col("b_errors")) / F.greatest(F.col("a_errors"), F.col("b_errors"), F.lit(1e-9)))
    axes = both.groupBy("a", "b").agg(
        F.avg(F.greatest(F.lit(0.0), cosine(F.col("a_position"), F.col("b_position")))).alias("mean_position"),
        F.coalesce(ruzicka(F.col("a_velocity"), F.col("b_velocity")), F.lit(0.0)).alias("velocity"),
        F.greatest(F.lit(0.0), 1 - F.avg(apart)).alias("contradiction_profile"),
        F.avg(F.greatest(F.lit(0.0), cosine(F.col("a_fork"), F.col("b_fork")))).alias("fork_significance"),
    )
    a, b = fingerprints.select(F.col("period").alias("a"), F.col("schemas").alias("sa")), fingerprints.select(F.col("period").alias("b"), F.col("schemas").alias("sb"))
    schemas = pairs.join(a, "a").join(b, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb"), 0.0).alias("schema_fingerprint"))
    joined = pairs.join(axes, ["a", "b"], "left").join(schemas, ["a", "b"], "left")
    return joined.select("a", "b", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in TRIAGE])


def triage(axes: DataFrame) -> DataFrame:
    """axes: pair and a similarity column per axis."""
    score = F.lit(0.0)
    for axis, w in TRIAGE.items():
        score = score + w * F.coalesce(F.col(axis), F.lit(0.0))
    return axes.withColumn("score", F.round(clamp(score), 6)).withColumn("passed", F.round(score, 6) >= TRIAGE_GATE)


def triage_feedback(false_positives: DataFrame) -> DataFrame:
    """false_positives: user, offset and a similarity column per axis.  The weights after each user's corrections, applied in order."""
    start = F.struct(*[F.lit(w).alias(a) for a, w in TRIAGE.items()])

    def step(acc, x):
        cut = {a: F.when(x[a] >= 0.5, F.greatest(F.lit(TRIAGE[a] * TRIAGE_FLOOR), acc[a] * TRIAGE_FACTOR)).otherwise(acc[a]) for a in TRIAGE}
        total = sum(cut.values(), F.lit(0.0))
        return F.struct(*[(c / total).alias(a) for a, c in cut.items()])

    moves = F.array_sort(F.collect_list(F.struct("offset", *TRIAGE)))
    w = false_positives.groupBy("user").agg(moves.alias("m")).select("user", F.aggregate("m", start, step).alias("w"))
    return w.select("user", *[F.round(F.col("w")[a], 6).alias(a) for a in TRIAGE])


def themes(messages: DataFrame, by: str, order: str, top: int = 3) -> DataFrame:
    """The most frequent words of four letters or more, ties by first use."""
    words = messages.select(by, order, F.posexplode(F.split(F.lower("text"), SPACE)).alias("i", "w")).withColumn("w", F.btrim("w", F.lit(".,;:!?\"'`()[]{}#<>/\\-_=+@$%^&*~")))
    kept = words.where((F.length("w") >= 4) & ~F.col("w").isin(*THEME_STOP_WORDS) & F.col("w").rlike(r"^\p{L}+$"))
    n = kept.groupBy(by, "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "i")).alias("first"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= top).select(by, "w", "n", "rank")


# Names of language models and their makers; the second list also has everyday senses.
BRANDS = (
    "Anthropic", "Claude Code", "Claude 3", "Claude 4", "claude mcp", "CLAUDE.md", ".claude/", "ChatGPT", "GPT-4", "GPT-3", "GPT-5", "OpenAI", "gpt-4o", "gpt-4-turbo", "o1-preview",
    "o3", "gemini-pro", "gemini-1.5", "Google AI", "Mixtral", "Cohere", "MCP", "LLM", "RAG", "fine-tune", "context window", "embedding",
)
AMBIGUOUS = ("Claude", "Opus", "Sonnet", "Haiku", "Gemini", "Bard", "Llama", "Mistral")


def _brand(term: str) -> str:
    escaped = "".join("\\" + c if c in ".^$*+?()[]{}|\\/-" else c for c in term)
    return ("\\b" if term[0].isalnum() else "") + escaped + ("\\b" if term[-1].isalnum() else "")


def _hits(text: Column, patterns) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(f"(?i){p}"))
    return total


def origin(text: Column, brands=BRANDS, ambiguous=AMBIGUOUS, turns=TURN_MARKERS) -> Column:
    """(is dialogue with a model, confidence) by the density of brand names and turn markers."""
    sure, maybe, turn = _hits(text, map(_brand, brands)), _hits(text, map(_brand, ambiguous)), _hits(text, turns)
    counted = sure + F.when((sure > 0) | (turn > 0), maybe).otherwise(0)
    per = 1000 / F.greatest(F.lit(1), F.length(text))
    b, t = counted * per, turn * per
    strong = (b >= 0.5) | (t >= 2.0)
    none = (counted == 0) & (turn == 0) & (F.length(text) >= 150)
    conf = F.when(strong, F.least(F.lit(0.95), 0.6 + 0.1 * (b + t))).when(none, 0.9).otherwise(0.4)
    return F.struct((strong | ~none).alias("dialogue"), F.round(conf, 6).alias("confidence"))


def hall(text: Column, halls: dict[str, tuple[str, ...]] = HALLS) -> Column:
    low = F.lower(text)
    return first_max([(k, count_contained(low, w)) for k, w in halls.items()], "general")


# Signals of session halls, in order of rank.
PREFERENCE = ("i prefer", "i usually", "i've been having trouble", "i've been feeling", "i've been struggling", "i want to", "i'm worried", "i've been thinking", "i've been considering", "lately i", "recently i", "i tend to")
ADVICE = ("i suggest", "i recommend", "here are", "you might want to", "option 1", "option 2", "1.", "2.", "3.", "first,", "second,", "you could try", "i would recommend", "my recommendation")
EVENTS = ("milestone", "graduation", "promotion", "anniversary", "birthday", "moved", "started", "finished", "completed", "launched", "opened", "achieved", "won", "accepted", "hired", "married", "born")
FACTS = ("degree", "major", "university", "college", "job", "position", "role", "company", "city", "country", "street", "born in", "grew up", "studied", "works at", "lives in", "years old", "salary", "budget")


def session_hall(user: Column, assistant: Column) -> Column:
    u, a = F.lower(user), F.lower(assistant)
    both = F.concat(u, a)
    return (
        F.when(contains_any(u, PREFERENCE), "hall_preferences").when(count_contained(a, ADVICE) >= 2, "hall_assistant_advice").when(contains_any(both, EVENTS), "hall_events")
        .when(count_contained(both, FACTS) >= 2, "hall_facts").otherwise("hall_general")
    )


def drift(similarity: DataFrame) -> DataFrame:
    """similarity: period and a column per axis.  Distance from the baseline by axis, their mean, and whether any is large."""
    axes = [c for c in similarity.columns if c != "period"]
    d = similarity.select("period", *[F.round(1 - F.col(c), 6).alias(c) for c in axes])
    total = sum((F.col(c) for c in axes), F.lit(0.0))
    return d.withColumn("overall", F.round(total / len(axes), 6)).withColumn("flagged", F.greatest(*[F.col(c) for c in axes], F.lit(0.0)) >= DRIFT)


AGGREGATIONS = {
    "take_first": lambda v, o: F.min_by(v, o), "last_writer": lambda v, o: F.max_by(v, o), "sum": lambda v, o: F.sum(v),
    "average": lambda v, o: F.avg(v), "multiply_clamped": lambda v, o: F.exp(F.sum(F.log(F.greatest(F.lit(0.05), F.least(F.lit(2.0), v))))),
    "rank_compose": lambda v, o: F.exp(F.avg(F.log(F.greatest(F.lit(0.05), F.least(F.lit(2.0), v))))),
}


def aggregate(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Every way of combining a group's values, in a column each."""
    return rows.groupBy(by).agg(*[F.round(f(F.col(value), F.col(order)), 6).alias(name) for name, f in AGGREGATIONS.items()])


def claims(text: Column) -> Column:
    """Relationship claims "X is Y's R" and "Y's R is X" as (x, y, relation)."""
    def hit(pattern, x, y, r):
        return F.when(F.regexp_extract(text, pattern, 0) != "", F.struct(F.regexp_extract(text, pattern, x).alias("x"), F.regexp_extract(text, pattern, y).alias("y"), F.regexp_extract(text, pattern, r).alias("relation")))

    return F.coalesce(hit(r"(\w+) is (\w+)'s (\w+)", 1, 2, 3), hit(r"(\w+)'s (\w+) is (\w+)", 3, 1, 2))


def check_facts(found: DataFrame, facts: DataFrame) -> DataFrame:
    """found: id, x, y, relation; facts: y, relation, known, ended.  Claims against what is known."""
    j = found.join(facts, ["y", "relation"], "left")
    issue = F.when(F.col("known").isNull(), "unknown").when((F.col("known") == F.col("x")) & F.col("ended"), "stale").when(F.col("known") == F.col("x"), "ok").when(F.levenshtein("known", "x") <= 2, "near_name").otherwise("mismatch")
    return j.select("id", "x", "y", "relation", "known", issue.alias("issue"))
