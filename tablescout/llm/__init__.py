"""Operations for preparing training text: deduplication, decontamination, scoring, classification, packing."""
