"""Query plans: the derived testbed, stakeholder bundles and the query catalog."""
