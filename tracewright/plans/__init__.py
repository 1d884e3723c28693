"""Plans made of several operators: calculated signals, conversion jobs, exports."""
