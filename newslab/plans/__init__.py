"""What a user calls: whole analyses made of the operators."""
