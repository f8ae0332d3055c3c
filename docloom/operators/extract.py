"""Field extraction by patterns, JSON repair, validation and fill-rate confidence."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of each type, and the patterns that find them.
FIELDS = {
    "invoice": "invoice_number invoice_date due_date vendor_name vendor_address customer_name customer_address subtotal tax_amount total_amount currency line_items".split(),
    "receipt": "store_name store_address transaction_date transaction_id payment_method items subtotal tax total".split(),
    "medical": "patient_name patient_dob provider_name facility_name document_date diagnosis medications procedures notes".split(),
    "legal": "document_title parties effective_date expiration_date key_terms jurisdiction".split(),
    "financial": "account_holder account_number statement_period opening_balance closing_balance total_deposits total_withdrawals transactions".split(),
    "identity": "card_type issuer_name member_name member_id group_number effective_date plan_type copay_pcp copay_specialist copay_er copay_urgent_care copay_rx deductible_individual deductible_family out_of_pocket_individual out_of_pocket_family coinsurance_in_network coinsurance_out_of_network rx_bin rx_pcn rx_group".split(),
    "unknown": "title date key_entities amounts summary".split(),
}
# Fields that hold numbers, lists of texts and lists of objects; all others hold text.
NUMBERS = frozenset("subtotal tax_amount total_amount tax total opening_balance closing_balance total_deposits total_withdrawals".split())
TEXT_LISTS = frozenset("diagnosis procedures parties key_terms key_entities".split())
OBJECT_LISTS = frozenset("line_items items medications transactions".split())
NUMBER_LISTS = frozenset({"amounts"})
INVOICE = {
    "invoice_number": r"(?i)(?:Invoice\s*(?:#|No\.?)|Inv\.?)\s*:?\s*([A-Za-z0-9-]+)",
    "invoice_date": r"(?i)(?:Date|Invoice Date)\s*:?\s*(\w+\s+\d{1,2},?\s*\d{4}|\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})",
    "total_amount": r"(?i)(?:Total|Amount Due|Balance Due)\s*:?\s*\$?\s*([\d,]+\.\d{2})",
}
#: Field: patterns in order of preference, of which the first hit counts, and the shape of the value.
IDENTITY = {
    "issuer_name": ([r"(?i)(?:Administered\s*By|Issued\s*By)\s+([\w\s]+?)(?:\s*Co\.|Inc\.|LLC|\.|\n)", r"(?i)(Cigna|Aetna|UnitedHealthcare|Blue\s*Cross|BCBS|Humana|Kaiser|Anthem)"], "{1}"),
    "plan_type": ([r"(?i)(Open\s*Access\s*Plus|PPO|HMO|EPO|POS|Medicare|Medicaid)"], "{1}"),
    "effective_date": ([r"(?i)(?:Effective|Coverage\s*Effective)\s*(?:Date)?:?\s*(\d{1,2}/\d{1,2}/\d{2,4})"], "{1}"),
    "member_id": ([r"(?i)ID\s*:?\s*([A-Z0-9]{6,}(?:\s+\d+)?)", r"(?i)Member\s*ID\s*:?\s*([A-Z0-9]+)", r"(?i)Subscriber\s*ID\s*:?\s*([A-Z0-9]+)"], "{1}"),
    "group_number": ([r"(?i)Group:?\s*(\d{5,})"], "{1}"),
    "member_name": ([r"Name:?\s+([A-Z][a-z]+\s+[A-Z][a-z]+)", r"Member\s*Name:?\s+([A-Z][a-z]+\s+[A-Z][a-z]+)"], "{1}"),
    "copay_pcp": ([r"(?i)PCP\s*(?:Visit)?\s*(?:Tier\s*\d+/\w+)?\s*\$(\d+)/\$?(\d+)"], "${1}/${2}"),
    "copay_specialist": ([r"(?i)Specialist\s*(?:Tier\s*\d+/\w+)?\s*\$(\d+)/\$?(\d+)"], "${1}/${2}"),
    "copay_er": ([r"(?i)Hospital\s*ER\s*\$?(\d+)"], "${1}"),
    "copay_urgent_care": ([r"(?i)Urgent\s*Care\s*\$?(\d+)"], "${1}"),
    "copay_rx": ([r"(?i)Rx\s*\$?(\d+)/(\d+)/(\d+)"], "${1}/${2}/${3}"),
    "deductible_individual": ([r"(?i)INN\s*DED\s*Ind/Fam\s*\$?(\d+)/\$?(\d+)"], "${1}"),
    "deductible_family": ([r"(?i)INN\s*DED\s*Ind/Fam\s*\$?(\d+)/\$?(\d+)"], "${2}"),
    "out_of_pocket_individual": ([r"(?i)INN\s*OOP\s*Ind/Fam\s*\$?(\d+)/\$?(\d+)"], "${1}"),
    "out_of_pocket_family": ([r"(?i)INN\s*OOP\s*Ind/Fam\s*\$?(\d+)/\$?(\d+)"], "${2}"),
    "coinsurance_in_network": ([r"(?i)In\s*(\d+)%?/(\d+)%"], "{1}%/{2}%"),
    "coinsurance_out_of_network": ([r"(?i)Out\s*[-—]?\s*(\d+)%?/(\d+)%"], "{1}%/{2}%"),
    "rx_bin": ([r"(?i)RxBIN\s*:?\s*(\d+)"], "{1}"),
    "rx_pcn": ([r"(?i)RxPCN\s*:?\s*([A-Z0-9]+)"], "{1}"),
    "rx_group": ([r"(?i)RxGroup\s*:?\s*(\d+)"], "{1}"),
}
CARD_TYPES = [("Insurance", r"(?i)insurance|health\s*plan|coverage"), ("Passport", r"(?i)passport"), ("Driver License", r"(?i)driver|license")]
MAX_CHARS = 8000


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one. The pattern runs once: nothing tests the match beside the filter."""
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, group)), lambda m: m != ""), F.lit(0))


def shaped(text: Column, pattern: str, shape: str) -> Column:
    """The shape with {n} in it filled from groups; null when the pattern does not match. Groups are taken from the match alone."""
    pieces = [(k % 2, p) for k, p in enumerate(re.split(r"\{(\d)\}", shape)) if k % 2 or p]
    if len(pieces) == 1:
        return first_group(text, pattern, int(pieces[0][1]))
    found = F.filter(F.array(F.regexp_extract(text, pattern, 0)), lambda m: m != "")
    fill = lambda m: F.concat(*[F.regexp_extract(m, pattern, int(p)) if is_group else F.lit(p) for is_group, p in pieces])
    return F.get(F.transform(found, fill), F.lit(0))


def invoice_fields(text: Column) -> dict[str, Column]:
    out = {f: F.lit(None).cast("string") for f in FIELDS["invoice"]}
    out |= {f: first_group(text, p) for f, p in INVOICE.items()}
    out["total_amount"] = F.replace(out["total_amount"], F.lit(","), F.lit("")).try_cast("double")
    return out


def identity_fields(text: Column) -> dict[str, Column]:
    kind = F.when(F.lit(False), F.lit(""))
    for name, p in CARD_TYPES:
        kind = kind.when(text.rlike(p), name)
    found = {f: F.regexp_replace(F.coalesce(*[shaped(text, p, shape) for p in patterns]), r"^\s+|\s+$", "") for f, (patterns, shape) in IDENTITY.items()}
    return {f: kind if f == "card_type" else found[f] for f in FIELDS["identity"]}


def fill_rate(fields: list[Column]) -> Column:
    """Share of fields that have a value."""
    n = F.lit(0)
    for f in fields:
        n = n + f.isNotNull().cast("int")
    return n / F.lit(float(len(fields)))


def repaired_json(answer: str) -> dict:
    """A model's answer as a dict: fences dropped, outermost braces, then quotes and trailing commas mended."""
    text = "\n".join(x for x in answer.strip().splitlines() if not x.strip().startswith("```"))
    lo, hi = text.find("{"), text.rfind("}")
    if lo >= 0 and hi > lo:
        text = text[lo : hi + 1]
    try:
        return json.loads(text)
    except ValueError:
        return json.loads(re.sub(r",\s*([}\]])", r"\1", text.replace("'", '"')))


def prompt(document_type: str, text: str) -> str:
    """What a language model is asked: the type, its fields and what they hold, and the first characters of the text."""
    kind = document_type if document_type in FIELDS else "unknown"
    holds = lambda f: "number" if f in NUMBERS else "list of numbers" if f in NUMBER_LISTS else "list of texts" if f in TEXT_LISTS else "list of objects" if f in OBJECT_LISTS else "text"
    fields = "\n".join(f"- {f} ({holds(f)})" for f in FIELDS[kind])
    about = "a document" if kind == "unknown" else f"a document of type {kind}"
    return f"Below is the recognised text of {about}. Answer with one JSON object and nothing else, null where the text does not say, with these fields:\n{fields}\n\nText:\n{text[:MAX_CHARS]}"


def _typed(field: str, value):
    """The value as its field holds it; raises where it does not fit."""
    if value is None:
        return None
    if field in NUMBERS:
        if isinstance(value, bool | int | float | str):
            return float(value)
    elif field in NUMBER_LISTS:
        if isinstance(value, list):
            return [float(v) for v in value]
    elif field in TEXT_LISTS or field in OBJECT_LISTS:
        kind = str if field in TEXT_LISTS else dict
        if isinstance(value, list) and all(isinstance(v, kind) for v in value):
            return value
    elif isinstance(value, str):
        return value
    raise ValueError(field)


def conformed(values: dict, document_type: str) -> dict:
    """Known fields only, null where missing: typed if all values fit their fields, else all as they were given."""
    raw = {f: values.get(f) for f in FIELDS.get(document_type, FIELDS["unknown"])}
    try:
        return {f: _typed(f, v) for f, v in raw.items()}
    except (ValueError, TypeError):
        return raw


def by_patterns(text: str, document_type: str) -> dict:
    """What the patterns find, for rows that a language model did not answer; null fields for types without patterns."""
    got: dict = {}
    if document_type == "invoice":
        got = {f: m[1] for f, p in INVOICE.items() if (m := re.search(p, text))}
        if "total_amount" in got:
            got["total_amount"] = float(got["total_amount"].replace(",", ""))
    elif document_type == "identity":
        for f, (patterns, shape) in IDENTITY.items():
            m = next((m for p in patterns if (m := re.search(p, text))), None)
            if m:
                got[f] = re.sub(r"\{(\d)\}", lambda g, m=m: m[int(g[1])], shape).strip()
        kind = next((name for name, p in CARD_TYPES if re.search(p, text)), None)
        got |= {"card_type": kind} if kind else {}
    return {f: got.get(f) for f in FIELDS.get(document_type, FIELDS["unknown"])}


def extract(docs: DataFrame, key: str, text: str, document_type: str, generate: Callable[[str], str]) -> DataFrame:
    """(key, data as JSON, confidence) from an injected generator, which is given the prompt. Where it fails, or
    its answer is beyond repair, the patterns decide; a blank text has no fields."""

    def run(it):
        for pdf in it:
            data, rate = [], []
            for t, kind in zip(pdf["text"], pdf["kind"], strict=True):
                got = {}
                if t and t.strip():
                    try:
                        got = conformed(repaired_json(generate(prompt(kind, t))), kind)
                    except Exception:  # noqa: BLE001  whatever a client raises
                        got = by_patterns(t, kind)
                data.append(json.dumps(got))
                rate.append(sum(v is not None for v in got.values()) / len(got) if got else 0.0)
            yield pd.DataFrame({"key": pdf["key"], "data": data, "confidence": rate})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(document_type).alias("kind"))
    return rows.mapInPandas(run, f"key {docs.schema[key].dataType.simpleString()}, data string, confidence double").withColumnRenamed("key", key)


def displayed_list(values: Column) -> Column:
    """The first five joined by commas; null for an empty list, as for an empty text."""
    return F.nullif(F.array_join(F.slice(values, 1, 5), ", "), F.lit(""))


def displayed(name: str, value: Column) -> Column:
    """A number as shown on screen: money for amounts and totals."""
    money = "amount" in name or "total" in name
    return F.concat(F.lit("$") if money else F.lit(""), F.format_number(value, 2))
