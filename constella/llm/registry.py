"""Registered queries of the corpus operators and the SQL they must agree with."""

from __future__ import annotations

import corpus_pipeline
from constella.llm import decontaminate, html_text, langid, media, mixing, ngram_join, packing, periodic, quality, secrets, token_store, warc, whitening


def queries() -> dict:
    return {
        "op1_media_columns": media.op1_media_columns,
        "op2_warc_archive": warc.op2_warc_archive,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op4_crf_text": html_text.op4_crf_text,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op7_byte_cnn": langid.op7_byte_cnn,
        "op6_packing": packing.op6_packing,
        "op8_huffman_ids": token_store.op8_huffman_ids,
        "op9_latent_decontamination": decontaminate.op9_latent_decontamination,
        "op10_quality_gam": quality.op10_quality_gam,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_mixed_sources": mixing.op12_mixed_sources,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
        "pipeline": corpus_pipeline.run,
        "secret_base_spans": secrets.base_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_archive": warc.OP2_SQL, "secret_base_spans": secrets.BASE_SQL}
