"""Reports as queries over relations."""
