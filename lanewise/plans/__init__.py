"""Reports, put together from the operators. Each returns a lazy DataFrame."""
