"""Plans: the registered queries of the core and the consignment pipeline."""
