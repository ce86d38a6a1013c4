"""Spark jobs for catalog curation, site-graph audits and corpus preparation."""
