"""Operations of a training-data pipeline: decontamination, near-duplicates, tokens, rules, shards, models, scans."""
