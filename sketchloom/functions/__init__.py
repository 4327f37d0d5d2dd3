"""Column functions: hashing, strings, entropy, versions, names, numbers and addresses."""
