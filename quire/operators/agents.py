"""Model calls as batch operators, with a deterministic offline model, and what is read from their answers."""

from __future__ import annotations

import json
import logging
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.schema import FLAGS, ISSUES

#: Fixed value: what the offline model answers.
MOCK_ANSWER = "[ترجمة تجريبية] هذا نص تجريبي يُستخدم في بيئة التطوير. في الإنتاج سيتم استبداله بالترجمة الفعلية من نموذج اللغة."
CONTEXT_CHARS = 200
CALLS_AT_ONCE = 3

Model = Callable[[str], str]
_MODELS: dict[str, Callable[..., Model]] = {}


def register_model(name: str, build: Callable[..., Model]) -> None:
    """Makes a model known by name; build(**settings) runs once per task and returns a function of the prompt."""
    _MODELS[name.strip().lower()] = build


def model(name: str, **settings: object) -> Callable[[], Model] | None:
    """A builder for the named model, or None for the offline one (also for names that aren't known)."""
    name = name.strip().lower()
    if name in ("fake", "mock"):
        return None
    if name not in _MODELS:
        logging.getLogger(__name__).warning("unknown model %r: the offline one is used", name)
        return None
    build = _MODELS[name]
    return lambda: build(**settings)


def chat_endpoint(url: str, name_of_model: str, token: str | None = None, timeout: float = 60.0) -> Model:
    """A model behind an HTTP endpoint for chat completions; nothing is sent before the first prompt."""

    def answer(prompt: str) -> str:
        body = json.dumps({"model": name_of_model, "messages": [{"role": "user", "content": prompt}]}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=timeout) as reply:  # noqa: S310
            return json.load(reply)["choices"][0]["message"]["content"]

    return answer


register_model("endpoint", chat_endpoint)


def ask(prompts: DataFrame, column: str, into: str, build: Callable[[], Model] | None = None, at_once: int | None = None) -> DataFrame:
    """Adds into(value, error): the model's answer to each prompt; an error is a value, not a failure.

    Without a model the answer is the offline one. Spark may repeat a task and so a call: write the rows before
    they are used twice. at_once bounds how many partitions, and so calls, run side by side.
    """
    if build is None:
        return prompts.withColumn(into, F.struct(F.lit(MOCK_ANSWER).alias("value"), F.lit(None).cast("string").alias("error")))

    @F.pandas_udf("value string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        answer = build()
        for b in batches:
            rows = []
            for p in b:
                try:
                    rows.append((answer(p), None))
                except Exception as error:  # noqa: BLE001
                    rows.append((None, str(error)))
            yield pd.DataFrame(rows, columns=["value", "error"])

    dealt = prompts.repartition(at_once) if at_once else prompts
    return dealt.withColumn(into, call(F.col(column)))


def glossary_lines(entries: Column, empty: str = "") -> Column:
    """Entries (term, translation) as a list, one a line."""
    text = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e["term"], F.lit(": "), e["translation"])), "\n")
    return F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, text).otherwise(empty)


# The wordings "(No context)", "Glossary term ... may not be used consistently", "[Translation error: ...]",
# "Issues flagged" and "OK" below are those that stored rows hold.
def context(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.substring(text, 1, CONTEXT_CHARS)).otherwise("(No context)")


def translate_prompt(source: Column, target: Column, entries: Column, before: Column, text: Column, after: Column) -> Column:
    return F.concat(F.lit("Translate the passage from "), source, F.lit(" to "), target, F.lit(". Translate nothing but the passage and answer with the translation alone.\n\nTerms:\n"), glossary_lines(entries, "(No glossary entries yet)"), F.lit("\n\nBefore it:\n"), context(before), F.lit("\n\nPassage:\n"), text, F.lit("\n\nAfter it:\n"), context(after))


def verify_prompt(text: Column, translation: Column, before: Column, after: Column, entries: Column) -> Column:
    return F.concat(F.lit('Name the faults of the translation; do not translate again. Answer with JSON: {"has_issues": bool, "issues": [{"phrase", "suggestion", "reason"}]}\n\nPassage:\n'), text, F.lit("\n\nTranslation:\n"), translation, F.lit("\n\nBefore it:\n"), before, F.lit("\n\nAfter it:\n"), after, F.lit("\n\nTerms:\n"), glossary_lines(entries))


def terms_prompt(text: Column, translation: Column, entries: Column) -> Column:
    return F.concat(F.lit('Name the terms that a person should decide on. Answer with a JSON array of {"term", "category", "suggested_translation", "reasoning"}, empty if there are none.\n\nPassage:\n'), text, F.lit("\n\nTranslation:\n"), translation, F.lit("\n\nDecided:\n"), glossary_lines(entries))


def parse_issues(answer: Column) -> Column:
    """has_issues, issues, score and summary; an answer that isn't such JSON counts as without issues."""
    x = F.from_json(answer, ISSUES)
    bad = F.coalesce(x["has_issues"], F.lit(False))
    return F.struct(bad.alias("has_issues"), F.coalesce(x["issues"], F.from_json(F.lit("[]"), "array<struct<phrase:string,suggestion:string,reason:string>>")).alias("issues"), F.when(bad, 0.7).otherwise(1.0).alias("score"), F.when(bad, "Issues flagged").otherwise("OK").alias("summary"))


def parse_flags(answer: Column) -> Column:
    """The flagged terms; none if the answer isn't a JSON array."""
    none = F.from_json(F.lit("[]"), FLAGS)
    return F.when(F.trim(answer).startswith("["), F.coalesce(F.from_json(answer, FLAGS), none)).otherwise(none)


def missing_terms(entries: Column, translation: Column) -> Column:
    """An error for each glossary translation that the translated text doesn't hold."""
    lost = F.filter(entries, lambda e: ~F.contains(translation, e["translation"]))
    return F.transform(lost, lambda e: F.concat(F.lit("Glossary term '"), e["translation"], F.lit("' may not be used consistently")))


def translate(chunks: DataFrame, build: Callable[[], Model] | None = None, source: str = "ur", target: str = "ar", at_once: int | None = None) -> DataFrame:
    """Translates, verifies and flags each chunk in turn. chunks: raw_text, n_minus_1, n_plus_1, glossary.

    Adds translation, errors, error, verification, flags and status. A call that fails leaves its message as the
    translation, or no issues, or no flags, and the chunk goes on.
    """
    c = F.col
    rows = chunks.withColumn("_p", translate_prompt(F.lit(source), F.lit(target), c("glossary"), c("n_minus_1"), c("raw_text"), c("n_plus_1")))
    rows = ask(rows, "_p", "_t", build, at_once).withColumn("translation", F.when(c("_t.error").isNull(), c("_t.value")).otherwise(F.concat(F.lit("[Translation error: "), c("_t.error"), F.lit("]"))))
    errors = F.concat(F.when(c("_t.error").isNotNull(), F.array(c("_t.error"))).otherwise(F.expr("cast(array() as array<string>)")), missing_terms(c("glossary"), c("translation")))
    rows = rows.withColumn("errors", errors).withColumn("error", F.when(F.size("errors") > 0, F.array_join("errors", "; ")))
    rows = ask(rows.withColumn("_p", verify_prompt(c("raw_text"), c("translation"), c("n_minus_1"), c("n_plus_1"), c("glossary"))), "_p", "_v", build)
    rows = ask(rows.withColumn("verification", parse_issues(c("_v.value"))).withColumn("_p", terms_prompt(c("raw_text"), c("translation"), c("glossary"))), "_p", "_f", build)
    return rows.withColumn("flags", parse_flags(c("_f.value"))).withColumn("status", F.lit("terminology_reviewed")).drop("_p", "_t", "_v", "_f")
