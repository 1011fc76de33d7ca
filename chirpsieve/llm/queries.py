"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import chat, language, media, minhash, mixing, packing, pii, quality, repair, search, sharding, simhash, substrings


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1,
        "op2_media": media.op2,
        "op3_simhash": simhash.op3,
        "op4_quality": quality.op4,
        "op5_chat": chat.op5,
        "op6_sharding": sharding.op6,
        "op7_substrings": substrings.op7,
        "op8_packing": packing.op8,
        "op9_minhash": minhash.op9,
        "op10_pii": pii.op10,
        "op11_language": language.op11,
        "op12_repair": repair.op12,
        "op13_search": search.op13,
        "minhash_near_duplicates": minhash.all_near_duplicates,
        "media_identified": media.identified,
        "media_payloads": media.payloads,
        "mixing_targets": mixing.all_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {"media_payloads": media.PAYLOADS_SQL, "mixing_targets": mixing.TARGETS_SQL, "op5_chat": chat.OP5_SQL, "op6_sharding": sharding.op6_sql(), "op7_substrings": substrings.OP7_SQL, "op12_repair": repair.OP12_SQL, "op13_search": search.OP13_SQL}
