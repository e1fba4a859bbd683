"""The operators as queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from corpusloom.session import ship

from .decontaminate import decontaminate
from .exact_dedup import deduplicate
from .licenses import scan
from .mixing import mix
from .oracles import ORACLE_SQL  # noqa: F401
from .periodic_runs import periodic_runs
from .pii import find_pii
from .quality import classify
from .simhash import near_duplicates
from .site_style import main_text
from .substrings import remove_repeats
from .token_counts import count_tokens
from .token_output import token_output
from .whitening import whiten


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark, sf_dir: str, name: str):
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_token_output(spark, sf_dir):
    return token_output(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), cached=250_000)


def op3_decontamination(spark, sf_dir):
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pii(spark, sf_dir):
    return find_pii(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return scan(_table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mix(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return deduplicate(_table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_html_extraction(spark, sf_dir):
    return main_text(_table(spark, sf_dir, "pages"))


def op12_whitening(spark, sf_dir):
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs(_table(spark, sf_dir, "documents"))


_ALL = (op1_token_counts, op2_token_output, op3_decontamination, op4_pii, op5_license_scan, op6_simhash, op7_substring_dedup, op8_mixing, op9_exact_dedup, op10_quality, op11_html_extraction, op12_whitening, op13_periodic_runs)
QUERIES = {f.__name__: f for f in _ALL}
