"""Operators for preparing training data. Nothing outside this package imports it."""

from . import ann, decontaminate, mixture, quality_cnn, secret_scan, sharding, simhash, suffix_dedup, token_counts, token_output


def queries() -> dict:
    found = (
        secret_scan.op1_secret_scan,
        decontaminate.op2_decontaminate,
        mixture.op3_source_mix,
        suffix_dedup.op4_suffix_dedup,
        simhash.op5_simhash,
        token_counts.op6_token_counts,
        token_output.op7_token_output,
        sharding.op8_sharding,
        quality_cnn.op9_quality,
        ann.op10_neighbours,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op2_decontaminate": decontaminate.ORACLE_SQL, "op3_source_mix": mixture.ORACLE_SQL, "op4_suffix_dedup": suffix_dedup.ORACLE_SQL}
