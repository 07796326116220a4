"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from quire.llm import decontaminate, embeddings, licenses, minhash, negatives, ngrams, packing, pieces, pii, secrets, substrings, trie
from quire.llm.common import read
from quire.llm.quality import quality


def op1_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op2_backoff_score(spark, sf_dir):
    return ngrams.score(read(spark, sf_dir, "documents"))


def op3_embedding_near_duplicates(spark, sf_dir):
    return embeddings.link(read(spark, sf_dir, "embeddings"))


def op4_decontamination(spark, sf_dir):
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_minhash_near_duplicates(spark, sf_dir):
    return minhash.link(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    return substrings.digest(substrings.remove(read(spark, sf_dir, "documents")))


def op7_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.digest(pii.scan(read(spark, sf_dir, "documents")))


def op10_quality_classifier(spark, sf_dir):
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_hard_negatives(spark, sf_dir):
    return negatives.mine(negatives.relabelled(read(spark, sf_dir, "embeddings")))


def op12_conversation_trie(spark, sf_dir):
    return trie.digest(*trie.nodes(*trie.rebuilt(trie.ordered(read(spark, sf_dir, "conversations")))))


def op13_sentencepiece(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.decode(pieces.encode(read(spark, sf_dir, "documents"), model), model))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_secret_scan, op2_backoff_score, op3_embedding_near_duplicates, op4_decontamination, op5_minhash_near_duplicates, op6_substring_dedup, op7_packing, op8_license_scan, op9_pii, op10_quality_classifier, op11_hard_negatives, op12_conversation_trie, op13_sentencepiece, pipeline)}


def oracle_sql():
    return {
        "op3_embedding_near_duplicates": embeddings.ORACLE,
        "op4_decontamination": decontaminate.ORACLE,
        "op5_minhash_near_duplicates": minhash.ORACLE,
        "op6_substring_dedup": substrings.ORACLE,
        "op8_license_scan": licenses.ORACLE,
        "op11_hard_negatives": negatives.ORACLE,
        "op12_conversation_trie": trie.ORACLE,
    }
