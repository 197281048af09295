"""Training-data operators: decontamination, repeats, archives, licences, scores, mixing, near copies."""
