"""Join plans and the catalog of registered queries."""
