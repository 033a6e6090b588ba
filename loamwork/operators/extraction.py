"""Claims out of texts by language models, with the client handed in: asking, voting, drafts, simulation, vocabularies."""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators.docs import CLAIM, parse_claims, vote
from loamwork.operators.graph import merge_edges
from loamwork.sources.services import CORPUS, bindings, model_answers, vocabulary_request

PROMPT = (
    "You read an abstract and list the causal statements that it makes. Answer with JSON only, of the form "
    '{"claims": [{"cause": "...", "effect": "...", "evidence": "...", "confidence": 0.0}]}. Cause and effect are short '
    "variable names in snake_case, evidence is a phrase of the abstract, confidence is between 0 and 1. Without such "
    'statements answer {"claims": []}.'
)

#: The kinds of services that may be asked.
BACKENDS = ("ollama", "openai", "anthropic")

#: Terms that annotators may use.
ANNOTATION_TERMS = """
precipitation mean_annual_precipitation temperature mean_annual_temperature
elevation slope aspect twi
clay sand silt bulk_density
soc ph cec parent_material
vegetation ndvi land_use fire_frequency
erosion weathering
""".split()

#: The canonical vocabulary by category.
VOCABULARY = {
    "climate": "precipitation mean_annual_precipitation temperature mean_annual_temperature aridity evapotranspiration fire fire_frequency",
    "relief": "elevation slope aspect twi curvature landform",
    "parent_material": "parent_material clay sand silt texture kaolinite gibbsite iron_oxide weathering",
    "chemistry": "ph cec soc soil_organic_carbon nitrogen phosphorus potassium calcium magnesium aluminium base_saturation bulk_density leaching",
    "vegetation": "vegetation ndvi biomass root_biomass land_use pasture no_till native_savanna cropland deforestation",
    "process": "erosion decomposition illuviation mineralisation soil_moisture water_retention microbial_activity",
    "outcome": "yield productivity soc_loss soc_accumulation nutrient_availability",
}


def vocabulary(spark: SparkSession) -> DataFrame:
    """term, category of the canonical vocabulary."""
    return spark.createDataFrame([(t, c) for c, terms in VOCABULARY.items() for t in terms.split()], "term string, category string")


def backend(config: dict) -> dict:
    """A voter's configuration with its id; an unknown kind of service is an error."""
    if not isinstance(config, dict) or config.get("backend") not in BACKENDS:
        raise ValueError(f"[backend] a configuration names a backend: {', '.join(BACKENDS)}")
    return config | {"id": config.get("id") or f"{config['backend']}:{config.get('model') or 'default'}"}


def request_of(config: dict, text: str) -> dict:
    """What to post to a service: url, headers and body of its chat interface. The key is looked up by the client."""
    c = backend(config)
    said = [{"role": "user", "content": f"{PROMPT}\n\n{text}"}]
    heat = c.get("temperature", 0)
    if c["backend"] == "ollama":
        return {"url": f"{c.get('host', 'http://localhost:11434')}/api/chat", "headers": {}, "body": {"model": c.get("model"), "messages": said, "stream": False, "format": "json", "options": {"temperature": heat}}}
    if c["backend"] == "openai":
        return {"url": "https://api.openai.com/v1/chat/completions", "headers": {"Authorization": "Bearer {key}"}, "body": {"model": c.get("model"), "messages": said, "temperature": heat, "response_format": {"type": "json_object"}}}
    return {"url": "https://api.anthropic.com/v1/messages", "headers": {"x-api-key": "{key}", "anthropic-version": "2023-06-01"}, "body": {"model": c.get("model"), "messages": said, "temperature": heat, "max_tokens": 2048}}


def answer_of(config: dict, reply: dict) -> str:
    """The text of a service's reply."""
    kind = backend(config)["backend"]
    if kind == "ollama":
        return reply["message"]["content"]
    if kind == "openai":
        return reply["choices"][0]["message"]["content"]
    return "".join(part.get("text", "") for part in reply["content"])


def asker(config: dict, post: Callable[[dict], dict]) -> Callable[[str], str]:
    """A function of a text that asks one service; post sends a request and gives the parsed reply."""
    return lambda text: answer_of(config, post(request_of(config, text)))


def service_is_up(get: Callable[[str], dict], host: str = "http://localhost:11434", model: str | None = None) -> bool:
    """Whether a local service answers, and has the model if one is named. Never raises."""
    try:
        names = [m.get("name", "") for m in get(f"{host}/api/tags").get("models", [])]
    except Exception:  # noqa: BLE001  whatever the client raises means that it isn't up
        return False
    return model is None or any(n == model or n.split(":")[0] == model for n in names)


def extract(df: DataFrame, text: str, ask: Callable[[str], str], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Claims of each row's text, with the row's columns."""
    return parse_claims(model_answers(df, text, ask, "", tries, wait), "answer").drop("answer", "error")


def ingest(df: DataFrame, text: str, source: str, ask: Callable[[str], str], least: float = 0.5, **args) -> DataFrame:
    """Merged edges of the claims of enough confidence; a claim without confidence isn't one of them."""
    rows = extract(df, text, ask, **args).filter(F.col("confidence") >= least)
    return merge_edges(rows.select("cause", "effect", F.col(source).alias("source"), "evidence", "confidence", F.lit(None).cast("string").alias("timestamp")))


def voted(df: DataFrame, key: str, text: str, voters: list[dict], posts: dict[str, Callable[[dict], dict]], rule: str = "majority", weights: dict[str, float] | None = None, **args) -> DataFrame:
    """Edges of each row on which its voters agree. A voter that fails has no claims; its error is told once."""
    configs = [backend(c) for c in voters]
    if len(configs) < 2:
        raise ValueError("[voted] two voters at least are needed")
    claims = None
    for c in configs:
        answered = model_answers(df.select(key, text), text, asker(c, posts[c["id"]]), "", **args)
        one = parse_claims(answered.withColumn("ord", F.lit(0)), "answer").withColumn("ord", F.monotonically_increasing_id()).withColumn("voter", F.lit(c["id"]))
        one = one.select(key, "voter", "cause", "effect", "evidence", "confidence", "ord")
        claims = one if claims is None else claims.unionByName(one)
    return vote(claims, rule, weights, len(configs), [key])


def ingest_voted(df: DataFrame, key: str, text: str, source: str, voters: list[dict], posts: dict, rule: str = "majority", least: float = 0.5, **args) -> DataFrame:
    """Merged edges of what the voters agree on with enough mean confidence."""
    agreed = voted(df, key, text, voters, posts, rule, **args).filter(F.col("mean_confidence") >= least).join(df.select(key, F.col(source).alias("source")), key)
    return merge_edges(agreed.select("cause", "effect", "source", "evidence", F.col("mean_confidence").alias("confidence"), F.lit(None).cast("string").alias("timestamp")))


def simulated_claims(record_id, terms: list[str] = ANNOTATION_TERMS, most: int = 4) -> list[dict]:
    """Claims drawn from a vocabulary, the same for the same id."""
    import random

    rng = random.Random(str(record_id))
    out = []
    for _ in range(rng.randrange(1, most + 1)):
        cause, effect = rng.sample(terms, 2)
        out.append({"cause": cause, "effect": effect, "evidence": f"{cause} affects {effect}", "confidence": round(rng.uniform(0.5, 0.99), 2)})
    return out


DRAFT = "struct<cause:string,effect:string,evidence:string,confidence:double,polarity:string,status:string>"


def preannotate(df: DataFrame, key: str = "abstract_id", text: str = "abstract_text", ask: Callable[[str], str] | None = None, name: str = "simulator") -> DataFrame:
    """df with draft claims (polarity +, status draft) and who made them: from a model's answers or, without one, drawn
    from the vocabulary by the record's id."""
    if ask is None:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(answer=[json.dumps({"claims": simulated_claims(i)}) for i in batch[key]])

        answered = df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", answer string")
    else:
        answered = model_answers(df, text, ask, "").drop("error")
    parsed = F.from_json(F.regexp_extract("answer", "(?s)\\{.*\\}", 0), f"struct<claims:array<{CLAIM}>>")["claims"]
    draft = F.transform(F.coalesce(parsed, F.array().cast(f"array<{CLAIM}>")), lambda c: F.struct(F.lower(F.trim(c["cause"])).alias("cause"), F.lower(F.trim(c["effect"])).alias("effect"), c["evidence"].alias("evidence"), c["confidence"].alias("confidence"), F.lit("+").alias("polarity"), F.lit("draft").alias("status")))
    kept = F.filter(draft.cast(f"array<{DRAFT}>"), lambda c: (c["cause"] != "") & (c["effect"] != "") & (c["cause"] != c["effect"]))
    return answered.withColumns({"claims": kept, "annotated_by": F.lit(name)}).drop("answer")


def simulated_answers(gold: DataFrame, key: list[str], recall: float = 0.82, precision: float = 0.86, mutate: float = 0.05, terms: list[str] = ANNOTATION_TERMS, seed: int = 1) -> DataFrame:
    """Claims as a model of that recall and precision would give them for gold claims (key columns, cause, effect).

    Each gold claim is found with probability recall, some with another effect; false ones come on top so that precision
    is met on average. All is drawn by hashes of the row, so reruns agree.
    """
    u = lambda k: (F.pmod(F.xxhash64(*key, "cause", "effect", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    term = lambda k: F.element_at(F.array(*map(F.lit, terms)), (F.floor(u(k) * len(terms)) + 1).cast("int"))
    # the ninth largest of ten uniform draws is distributed as Beta(9, 2)
    confidence = F.element_at(F.array_sort(F.array(*[u(10 + i) for i in range(10)])), 9)
    found = gold.filter(u(1) < recall).select(*key, "cause", F.when(u(2) < mutate, term(3)).otherwise(F.col("effect")).alias("effect"), confidence.alias("confidence"))
    false = gold.filter(u(4) < recall * (1 - precision) / precision).select(*key, term(5).alias("cause"), term(6).alias("effect"), (0.9 * confidence).alias("confidence"))
    return found.unionByName(false.filter("cause <> effect"))


# literature and vocabularies


def article_abstract(article: dict) -> str | None:
    """The abstract of an article record, wherever it is: plain, in the article's data by language, in a numbered field
    by language; English before any other."""

    def pick(x):
        if isinstance(x, str):
            return x.strip() or None
        if isinstance(x, dict):
            return next((p for p in (pick(x.get("en")), *(pick(v) for k, v in x.items() if k != "en")) if p), None)
        if isinstance(x, list):
            english = [e for e in x if isinstance(e, dict) and e.get("l") == "en"]
            return next((p for e in [*english, *x] if (p := pick(e.get("a") if isinstance(e, dict) and "a" in e else e))), None)
        return None

    data = article.get("article_meta") or article.get("article") or {}
    return pick(article.get("abstract")) or pick(data.get("abstract")) or pick(article.get("v83") or data.get("v83"))


def article_corpus(spark: SparkSession, fetch: Callable[[str, int, int], list[dict]], queries: list[str], most: int = 50, page: int = 20, first_year: int | None = None, last_year: int | None = None, source: str = "articles") -> DataFrame:
    """Corpus rows of an article service without cursors: fetch(query, offset, size) gives records; a query is a task."""
    columns = [f.split()[0] for f in CORPUS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q in batch["query"]:
                for offset in range(0, most, page):
                    records = fetch(q, offset, min(page, most - offset))
                    rows = []
                    for r in records:
                        year = int(str(r.get("publication_date") or r.get("year") or "")[:4] or 0) or None
                        if (first_year and (year or 0) < first_year) or (last_year and (year or 9999) > last_year):
                            continue
                        rows.append((source, r.get("title"), article_abstract(r), year, (r.get("doi") or "").lower() or None, r.get("url")))
                    yield pd.DataFrame(rows, columns=columns).astype({"year": "Int32"})
                    if len(records) < page:
                        break

    asked = spark.createDataFrame([(q,) for q in queries], "query string").repartition(max(1, len(queries)))
    return asked.mapInPandas(run, CORPUS).filter(F.length(F.trim("abstract")) > 0)


def align_terms(terms: DataFrame, fetch: Callable[[str], str], cache: DataFrame | None = None, active: int = 5, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """term, concept, label, distance: the nearest label that a vocabulary service has for each term; null where it has
    none or keeps failing. Known answers come from the cache (the same columns); at most `active` tasks ask at a time."""
    asked = terms.select("term").distinct()
    if cache is not None:
        asked = asked.join(cache.select("term"), "term", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for term in batch["term"]:
                found = []
                for k in range(tries):
                    try:
                        found = bindings(fetch(vocabulary_request(term)))
                        break
                    except Exception as e:  # noqa: BLE001  whatever a client raises
                        if k + 1 == tries:
                            warnings.warn(f"{term}: {e}", stacklevel=1)
                        else:
                            time.sleep(wait * 2**k)
                out += [(term, c, label) for c, label in found] or [(term, None, None)]
            yield pd.DataFrame(out, columns=["term", "concept", "label"])

    answers = asked.repartition(active).mapInPandas(run, "term string, concept string, label string")
    near = F.levenshtein(F.lower(F.translate("term", "_", " ")), F.lower("label"))
    best = answers.groupBy("term").agg(F.min(F.when(F.col("label").isNotNull(), F.struct(near.alias("distance"), "label", "concept"))).alias("b"))
    fresh = best.select("term", "b.concept", "b.label", "b.distance")
    return fresh if cache is None else fresh.unionByName(cache.join(terms.select("term").distinct(), "term", "left_semi").select("term", "concept", "label", "distance"))
