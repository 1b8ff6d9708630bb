"""Declarative analyses: specs, their validation, execution, artifacts, and the services around them."""
