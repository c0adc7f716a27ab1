"""Queries and SQL of the corpus operators."""

from . import op01_rules, op02_mixing, op03_toxicity, op04_substring, op05_suffix, op06_packing, op07_winnow, op08_setsketch, op09_secrets, op10_chat, op11_subspace, op12_tiers, op13_merkle


def queries():
    return {
        "op1_rules": op01_rules.op1_rules,
        "op2_mixing": op02_mixing.op2_mixing,
        "op3_toxicity": op03_toxicity.op3_toxicity,
        "op4_substring": op04_substring.op4_substring,
        "op5_suffix": op05_suffix.op5_suffix,
        "op6_packing": op06_packing.op6_packing,
        "op7_winnow": op07_winnow.op7_winnow,
        "op8_setsketch": op08_setsketch.op8_setsketch,
        "op9_secrets": op09_secrets.op9_secrets,
        "op10_chat": op10_chat.op10_chat,
        "op11_subspace": op11_subspace.op11_subspace,
        "op12_tiers": op12_tiers.op12_tiers,
        "op13_merkle": op13_merkle.op13_merkle,
    }


def oracle_sql():
    return {"op7_winnow": op07_winnow.SQL, "op10_chat": op10_chat.SQL, "op12_tiers": op12_tiers.SQL, "op13_merkle": op13_merkle.SQL}
