"""Training-data operators: license scan, near duplicates, language ID, decontamination,
mixing, sharding, page extraction, LM scoring and line dedup. Nothing else imports this."""
