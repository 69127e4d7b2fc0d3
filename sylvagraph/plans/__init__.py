"""Session settings, cut lineage and fixpoint loops."""
