"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from millrace.llm.chat import op6_chat_format
from millrace.llm.fill_middle import op11_fill_in_middle
from millrace.llm.html_text import op5_html_text
from millrace.llm.mixing import op10_mix
from millrace.llm.near_vectors import op2_near_vectors
from millrace.llm.ngram_join import op3_ngram_jaccard
from millrace.llm.oracles import ORACLE_SQL
from millrace.llm.pii import op9_pii
from millrace.llm.prefix_trie import op13_prefix_trie
from millrace.llm.quality import op1_quality_rules
from millrace.llm.sentencepiece import op8_sentencepiece
from millrace.llm.token_files import op12_token_files
from millrace.llm.toxicity import op4_toxicity
from millrace.llm.warc import op7_warc


def pipeline(spark, sf_dir: str):
    """All stages of the pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_near_vectors": op2_near_vectors,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_html_text": op5_html_text,
    "op6_chat_format": op6_chat_format,
    "op7_warc": op7_warc,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_pii": op9_pii,
    "op10_mix": op10_mix,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_files": op12_token_files,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
